"""Personal data, BPE, packing and media: brute force, exact round trips, odd inputs."""

import random
import re
import zlib
from hashlib import sha256
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickloom.llm import bpe, media, packing, pii
from clickloom.llm.common import prepare, table

SF = "/root/testdata/sf0.001"

# ---- personal data

NAIVE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def naive_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(NAIVE.items()):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def base_text(text):
    return pii.span_text([s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS])


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", ".", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "(", ")", "%", "é", "x@y.zz", "+1 (269) 555-3296", "1.2.3.4", "000001.2.3.4", "_", "\n"]
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert base_text(text) == naive_base(text), text


def test_long_tokens_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 200_000, "+1(" * 100_000, "1 " * 200_000, "a.b@c" * 50_000):
        pii.find_spans(text)


def test_added_kinds_need_check_digits_or_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("pay to IBAN GB82 WEST 1234 5698 7654 32 today") == ["iban"]
    assert kinds("code GB83 WEST 1234 5698 7654 32 today") == []
    assert kinds("social security 536-90-4399") == ["ssn"]
    assert kinds("call 269 555-3296") == ["local_phone"]
    assert kinds("order no 269 555-3296") == []


def test_pii_query_and_masks(spark):
    prepare(spark)
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.detect(docs).collect():
        assert r["base_sha256"] == sha256(naive_base(texts[r["doc_id"]]).encode()).hexdigest()
        assert r["n_email"] == sum(s["kind"] == "email" for s in r["found"])
    masked = pii.mask(docs, chars_col="n_chars")
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert naive_base(r["text"] or "") == "" and r["n_chars"] == len(r["text"])


def test_pii_of_odd_rows(spark):
    rows = [(None, None, "a"), (1, "", "b"), (1, "x@y.com", "c"), (1, "x@y.com", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert sorted(r["spans"] for r in pii.detect(df).collect()) == ["", "", "email:0:7", "email:0:7"]
    assert sorted(str(r["text"]) for r in pii.mask(df).collect()) == ["", "<EMAIL>", "<EMAIL>", "None"]
    assert pii.detect(df.limit(0)).collect() == []


# ---- BPE


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), bpe.Encoder(bpe.load_tables(path)), path


def test_bpe_of_random_texts(vocabulary):
    reference, encoder, _ = vocabulary
    rng = random.Random(1)
    pieces = list("abeht 1\n\t!?_\x1c\x85  éß中😀́²½٣Ⅷʰİ​　\x00") + ["th", "ing", "  ", "文字", "'s", "'ll", "aaaa", "<|endoftext|>", "<|endo"]
    for _ in range(5_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(16)))
        want = reference.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want, text
        assert encoder.decode(want).decode("utf-8", "replace") == reference.decode(want, skip_special_tokens=False)


def test_bpe_of_one_long_word(vocabulary):
    reference, encoder, _ = vocabulary
    rng = random.Random(4)
    for letters in ("ab", "aeint", "a"):
        text = "".join(rng.choice(letters) for _ in range(5_000))
        assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, vocabulary):
    reference, _, path = vocabulary
    docs = table(prepare(spark), SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.encode_digests(docs, path).collect():
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_and_odd_rows(spark, vocabulary):
    path = vocabulary[2]
    rows = [(None, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").drop("ids")
    ids = bpe.encode(df, path)
    assert sorted(r["text"] for r in bpe.decode(ids, path).collect()) == ["", "", "a b", "a b"]
    clash = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    assert sorted(r["n_tokens"] for r in bpe.encode_digests(clash, path).collect()) == [0, 0, 2, 2]
    assert bpe.encode_digests(clash.limit(0), path).collect() == []


# ---- packing


def waste(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in histogram)


def test_bounds_are_optimal():
    rng = random.Random(6)
    for _ in range(300):
        lengths = rng.sample(range(40), rng.randrange(1, 8))
        histogram = [(length, rng.randrange(1, 50)) for length in lengths]
        k = rng.randrange(1, 5)
        bounds = packing.best_bounds(histogram, k)
        assert len(bounds) <= k and bounds[-1] == max(lengths)
        rest = sorted(lengths)[:-1]
        best = min(
            waste(histogram, [*c, max(lengths)]) for size in range(min(k, len(lengths))) for c in combinations(rest, size)
        )
        assert waste(histogram, bounds) == best
    assert packing.best_bounds([], 4) == []


@pytest.mark.parametrize("range_rows", [3, 100_000])
def test_batches_keep_the_budget(spark, range_rows):
    docs = table(prepare(spark), SF, "documents")
    rows = packing.pack(docs, budget=2_000, range_rows=range_rows).collect()
    lengths = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == lengths
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in batches.items():
        bound = members[0]["bound"]
        assert all(r["n_tokens"] <= bound for r in members)
        assert len(members) * bound <= 2_000 or len(members) == 1
        assert sorted(r["position"] for r in members) == list(range(len(members)))
        full = max(1, 2_000 // max(bound, 1))
        assert len(members) == full or (bucket, batch + 1) not in batches
    order = sorted(rows, key=lambda r: (r["bucket"], r["batch"], r["position"]))
    keys = [(r["n_tokens"], r["doc_id"]) for r in order]
    assert keys == sorted(keys)


def test_packing_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "a b", 1), (1, "a b", 1), (9, "w " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bound int")
    found = packing.pack(df, budget=100).collect()
    assert len(found) == 5 and max(r["n_tokens"] for r in found) == 50_000
    assert packing.pack(df.limit(0)).collect() == []


# ---- media


def test_pictures_are_lossless():
    rng = random.Random(8)
    for n in (0, 1, 191, 192, 193, 5_000):
        text = "".join(rng.choice("aé中😀 \n") for _ in range(n))
        payload, size = media.payload_of(text)
        assert len(payload) % 192 == 0 and payload[:size] == text.encode() and set(payload[size:]) <= {32}
        assert media.from_png(media.to_png(payload)) == payload


def test_media_query(spark, tmp_path):
    docs = table(prepare(spark), SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = media.media_features(docs, uri=f"file://{tmp_path}/m").collect()
    assert len(found) == len(texts)
    for r in found:
        payload, n = media.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload))
        assert r["payload_sha256"] == sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        picture = media.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(picture), sha256(picture).hexdigest())
        assert r["feature"] == media.feature_of(payload)


def test_every_cut_reads_each_member_once(spark, tmp_path):
    """Whatever the size of the byte ranges, and with archives that other programs can read."""
    import zipfile

    docs = table(prepare(spark), SF, "documents")
    uri = f"file://{tmp_path}/m"
    media.store(docs, uri)
    n = docs.count()
    for size in (1_000, 50_000, 1 << 30):
        rows = spark.read.format("media_archive").option("rangeBytes", size).load(uri)
        assert rows.count() == n and rows.select("name").distinct().count() == n
    names = [name for p in (tmp_path / "m").glob("*.zip") for name in zipfile.ZipFile(p).namelist()]
    assert len(names) == n


def test_a_damaged_read_is_tried_again():
    from pyarrow import fs

    class Flaky:
        """Gives damaged bytes on the first opening."""

        def __init__(self, data):
            self.data, self.opened = data, 0

        def open_input_file(self, path):
            import io

            self.opened += 1
            return io.BytesIO(self.data if self.opened > 1 else self.data.replace(b"pay", b"PAY"))

    import io

    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    writer = media.ArchiveWriter(out)
    writer.add("1/3.png", b"first pay")
    writer.add("2/3.png", b"second pay")
    writer.close()
    folder = Flaky(out.getvalue())
    members = list(media.members_in(io.BytesIO(folder.data), len(folder.data), 0, len(folder.data)))
    assert [m[0] for m in members] == ["1/3.png", "2/3.png"]
    _, offset, crc, n = members[1]
    data, _ = media.read_member(folder, "x", offset, crc, n)
    assert data == b"second pay" and folder.opened == 2
    with pytest.raises(OSError):
        media.read_member(folder, "x", offset, crc + 1, n)
    assert isinstance(fs.LocalFileSystem(), fs.FileSystem)


def test_media_of_odd_rows(spark, tmp_path):
    rows = [(None, None, b"x"), (1, "", b"x"), (1, "", b"x"), (2, "é" * 200_000, b"x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    found = media.media_features(df, uri=f"file://{tmp_path}/a").collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"]) for r in found) == [
        ("1", 0, 192),
        ("1", 0, 192),
        ("2", 400_000, 400_128),
        ("None", 0, 192),
    ]
    assert media.media_features(df.limit(0), uri=f"file://{tmp_path}/b").collect() == []


def test_media_names_are_no_ids(spark, tmp_path):
    rows = [("null", "a"), (None, "b"), ("=x/1", "c"), ("", "d")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = media.media_features(df, uri=f"file://{tmp_path}/n").collect()
    sha = lambda t: sha256(t.encode() + b" " * (192 - len(t))).hexdigest()
    assert {(r["doc_id"], r["payload_sha256"]) for r in found} == {(i, sha(t)) for i, t in rows}


@pytest.mark.parametrize("kind, ids", [("long", [-(2**63), -9 * 10**18, 5, 9 * 10**18, 2**63 - 1, None, None, 5]), ("string", ["a", "", None, None, "zz", "b", "c", "a"])])
def test_packing_takes_any_id(spark, kind, ids):
    rows = [(i, "w " * 3) for i in ids] + [(ids[0], "w " * 5)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    for range_rows in (1, 3, 1000):
        found = packing.pack(df, budget=9, range_rows=range_rows).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted((str(i), len(t.split())) for i, t in rows)
        places = [(r["bucket"], r["batch"], r["position"]) for r in found]
        assert len(set(places)) == len(places)
        assert all(r["position"] < max(1, 9 // r["bound"]) for r in found)
