"""Keyed state on streams: user and item features, sliding counts, decayed interest.

Each processor keeps the state of one key and emits the key's new feature row
once per micro-batch (update mode). The Arrow batches of a key are folded one by
one, in any order. What depends on the order (ts, arrival, pos), consecutive
requests and decay, keeps a few narrow columns of the key's rows of one
micro-batch and sorts them at its end; the source's byte limit bounds those.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clickloom.functions.scalars import DAY_MS, MINUTE_MS, event_kind, local_day
from clickloom.operators.cumulative import ITEM_KINDS
from clickloom.operators.decay import BRAND_KINDS, CATEGORY_KINDS, HALF_LIFE_DAYS
from clickloom.operators.sliding import SPANS

# The driver-side worker of a stateful stream does not get the shipped package,
# so the processors of this module travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ["ts", "arrival", "pos"]


class _Totals(StatefulProcessor):
    """A value state of counters and last values."""

    schema = ""
    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", self.schema)

    def read(self, start: dict[str, Any]) -> dict[str, Any]:
        return dict(zip(self.names, self.state.get())) if self.state.exists() else dict(start)

    def write(self, values: dict[str, Any]) -> None:
        self.state.update(tuple(values[n] for n in self.names))

    def close(self) -> None:
        pass


USER_OUT = (
    "user_id string, user_age int, user_city string, user_level int, total_pv long, total_click long, "
    "total_cart long, total_fav long, total_buy long, last_active_ts long, active_days long, update_ts long"
)


class UserFeatures(_Totals):
    schema = (
        "user_age int, user_city string, user_level int, total_pv long, total_click long, total_cart long, "
        "total_fav long, total_buy long, last_active_ts long, last_arrival long, active_days long, update_ts long, last_req string"
    )
    names = tuple(part.split()[0] for part in schema.split(", "))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.days = handle.getMapState("days", "day int", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.read({n: None if n.startswith(("user_", "last_")) else 0 for n in self.names})
        shows, days = [], set()
        known, last_seen, last_came = None, None, None
        for pdf in rows:
            for kind, n in pdf["kind"].value_counts().items():
                if kind != "pv":
                    s[f"total_{kind}"] += int(n)
            days.update(int(d) for d in pdf["day"].unique())
            s["update_ts"] = max(s["update_ts"], int(pdf["ts"].max()))
            came = pdf.loc[pdf["arrival"].idxmax()]
            if last_came is None or came["arrival"] >= last_came["arrival"]:
                last_came = came
            shown = pdf.loc[(pdf["kind"] == "pv") & pdf["req_id"].notna(), ["ts", "arrival", "req_id"]]
            shows.append(shown.drop_duplicates())  # all items of one show carry its request
            if not s["user_age"]:
                pdf = pdf.sort_values(ORDER, kind="stable")
                aged = pdf[pdf["user_age"].fillna(0) != 0]
                if len(aged):
                    known = _by_order(min, known, aged.iloc[0])
                last_seen = _by_order(max, last_seen, pdf.iloc[-1])
        for day in days:
            if not self.days.containsKey((day,)):
                self.days.updateValue((day,), (True,))
                s["active_days"] += 1
        requests = pd.concat(shows).sort_values(["ts", "arrival"], kind="stable")["req_id"].to_numpy(dtype=object)
        if len(requests):
            s["total_pv"] += int((requests != np.r_[np.array([s["last_req"]], object), requests[:-1]]).sum())
            s["last_req"] = requests[-1]
        if not s["user_age"]:
            r = last_seen if known is None else known
            s.update(user_age=int(r["user_age"]), user_city=r["user_city"], user_level=int(r["user_level"]))
        if s["last_arrival"] is None or last_came["arrival"] >= s["last_arrival"]:
            s["last_arrival"], s["last_active_ts"] = int(last_came["arrival"]), int(last_came["ts"])
        self.write(s)
        out = {n: [s[n]] for n in self.names if n not in ("last_arrival", "last_req")}
        out["user_city"] = [s["user_city"] or "unknown"]
        yield pd.DataFrame({"user_id": [key[0]], **out})[[c.split()[0] for c in USER_OUT.split(", ")]]


def user_feature_stream(dwd: DataFrame) -> DataFrame:
    rows = dwd.where(F.col("uid").isNotNull()).select(
        "uid", *ORDER, "req_id", "user_age", "user_city", "user_level", event_kind().alias("kind"), local_day("ts").alias("day")
    )
    return rows.groupBy("uid").transformWithStateInPandas(UserFeatures(), USER_OUT, "Update", "None")


ITEM_OUT = (
    "item_id string, category_id int, item_brand string, item_price double, total_detail_click long, total_buy long, "
    "total_cart long, total_fav long, uv long, conversion_rate double, update_ts long"
)


class ItemFeatures(_Totals):
    schema = (
        "category_id int, item_brand string, item_price double, total_click long, total_buy long, total_cart long, "
        "total_fav long, uv long, update_ts long"
    )
    names = tuple(part.split()[0] for part in schema.split(", "))

    def __init__(self, user_ttl_ms: int | None = None):
        self.user_ttl_ms = user_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        ttl = {} if self.user_ttl_ms is None else {"ttlDurationMs": self.user_ttl_ms}
        self.users = handle.getMapState("users", "uid string", "seen boolean", **ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.read({n: None if n.startswith(("item_", "cat")) else 0 for n in self.names})
        first_known, last_seen, met = None, None, set()
        for pdf in rows:
            for kind, n in pdf["kind"].value_counts().items():
                s[f"total_{kind}"] += int(n)
            fresh = set(pdf["uid"].dropna().unique()) - met
            met |= fresh
            for uid in fresh:
                if not self.users.containsKey((uid,)):
                    self.users.updateValue((uid,), (True,))
                    s["uv"] += 1
            s["update_ts"] = max(s["update_ts"], int(pdf["ts"].max()))
            pdf = pdf.sort_values(ORDER, kind="stable")
            known = pdf[pdf["item_brand"].notna() & (pdf["item_brand"] != "unknown")]
            if len(known):
                first_known = _by_order(min, first_known, known.iloc[0])
            last_seen = _by_order(max, last_seen, pdf.iloc[-1])
        if s["item_brand"] in (None, "unknown"):
            r = last_seen if first_known is None else first_known
            s.update(category_id=int(r["category_id"]), item_brand=r["item_brand"], item_price=float(r["item_price"]))
        self.write(s)
        rate = s["total_buy"] / s["total_click"] if s["total_click"] else 0.0
        yield pd.DataFrame(
            {
                "item_id": [key[0]], "category_id": [s["category_id"]], "item_brand": [s["item_brand"] or "unknown"],
                "item_price": [s["item_price"]], "total_detail_click": [s["total_click"]], "total_buy": [s["total_buy"]],
                "total_cart": [s["total_cart"]], "total_fav": [s["total_fav"]], "uv": [s["uv"]],
                "conversion_rate": [rate], "update_ts": [s["update_ts"]],
            }
        )


def _by_order(pick, a: pd.Series | None, b: pd.Series) -> pd.Series:
    """The earlier or later of two rows."""
    return b if a is None else pick(a, b, key=lambda r: tuple(r[c] for c in ORDER))


def item_feature_stream(dwd: DataFrame, user_ttl_ms: int | None = None) -> DataFrame:
    """``user_ttl_ms`` lets the distinct-user state of idle users expire."""
    rows = dwd.withColumn("kind", event_kind()).where(F.col("item_id").isNotNull() & F.col("kind").isin(*ITEM_KINDS))
    rows = rows.select("item_id", *ORDER, "uid", "kind", "category_id", "item_brand", "item_price")
    mode = "None" if user_ttl_ms is None else "ProcessingTime"
    return rows.groupBy("item_id").transformWithStateInPandas(ItemFeatures(user_ttl_ms), ITEM_OUT, "Update", mode)


SLIDING_OUT = "key string, pv_5min long, pv_1h long, click_5min long, click_1h long, last_ts long"


class SlidingCounts(StatefulProcessor):
    """Minute buckets per key; buckets more than an hour older than the newest event are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", "minute long", "pv long, click long")
        self.newest = handle.getValueState("newest", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.newest.get()[0] if self.newest.exists() else 0
        kept = {k[0]: list(v) for k, v in self.buckets.iterator()}
        before = set(kept)
        for pdf in rows:
            now = max(now, int(pdf["ts"].max()))
            for (minute, kind), n in pdf.groupby([pdf["ts"] // MINUTE_MS, "kind"]).size().items():
                kept.setdefault(int(minute), [0, 0])[0 if kind == "pv" else 1] += int(n)
            kept = {m: v for m, v in kept.items() if m * MINUTE_MS >= now - 60 * MINUTE_MS}
        out = {}
        for name, n in SPANS.items():
            inside = [v for m, v in kept.items() if m * MINUTE_MS >= now - n * MINUTE_MS]
            out[f"pv_{name}"] = [sum(v[0] for v in inside)]
            out[f"click_{name}"] = [sum(v[1] for v in inside)]
        self.newest.update((now,))
        for m in before - set(kept):
            self.buckets.removeKey((m,))
        for m, v in kept.items():
            self.buckets.updateValue((m,), tuple(v))
        yield pd.DataFrame({"key": [key[0]], **out, "last_ts": [now]})[["key", "pv_5min", "pv_1h", "click_5min", "click_1h", "last_ts"]]

    def close(self) -> None:
        pass


def sliding_stat_stream(dwd: DataFrame, key: str = "uid") -> DataFrame:
    rows = dwd.withColumn("kind", event_kind()).where(F.col("kind").isin("pv", "click") & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("key"), *ORDER, "kind")
    return rows.groupBy("key").transformWithStateInPandas(SlidingCounts(), SLIDING_OUT, "Update", "None")


class DecayedCounts(StatefulProcessor):
    """Decayed counters per (user, entity) with one clock for all counters of the pair.

    The key is the user: a batch reads the state of all entities of a user once and writes it once.
    """

    def __init__(self, kinds: tuple[str, ...], half_life_days: float = HALF_LIFE_DAYS):
        self.kinds = kinds
        self.rate = math.log(2.0) / (half_life_days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decayed", "entities array<string>, last array<long>, counts array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        width, stored = len(self.kinds), self.state.get()
        names, last, counts = ([], [], []) if stored is None else stored
        known = {e: (t, list(counts[i * width : (i + 1) * width])) for i, (e, t) in enumerate(zip(names, last))}
        parts = [[pdf[c].to_numpy() for c in ("entity", *ORDER, "kind")] for pdf in rows]
        entity, ts, arrival, pos, kind = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]
        code, values = pd.factorize(np.asarray(entity, object), use_na_sentinel=False)
        order = np.lexsort((pos, arrival, ts, code))
        code, ts, kind = code[order], ts[order].astype(np.int64), kind[order]
        touched = []
        for start, end in zip(*(np.searchsorted(code, np.arange(len(values)), side) for side in ("left", "right"))):
            name = values[code[start]]
            name = name if isinstance(name, str) else None
            before, value = known.get(name, (None, [0.0] * width))
            mine, of = ts[start:end], kind[start:end]
            gaps = np.maximum(np.diff(mine, prepend=mine[0] if before is None else before), 0) * self.rate
            for n, k in enumerate(self.kinds):
                # a counter decays by the gaps before its own events only
                decay = np.cumsum(gaps[of == k])
                if len(decay):
                    value[n] = value[n] * math.exp(-decay[-1]) + float(np.exp(decay - decay[-1]).sum())
            known[name] = (int(mine[-1]), value)
            touched.append(name)
        self.state.update((list(known), [t for t, _ in known.values()], [c for _, v in known.values() for c in v]))
        found = {f"{k}_cnt": [known[e][1][n] for e in touched] for n, k in enumerate(self.kinds)}
        yield pd.DataFrame({"uid": key[0], "entity": [str(e) for e in touched], **found, "last_ts": [known[e][0] for e in touched]})

    def close(self) -> None:
        pass


def decay_stream(dwd: DataFrame, entity: str = "category") -> DataFrame:
    """``entity`` is 'category' (five counters) or 'brand' (click and buy)."""
    if entity == "category":
        kinds, column = CATEGORY_KINDS, F.col("category_id").cast("string")
    else:
        kinds, column = BRAND_KINDS, F.coalesce("item_brand", F.lit("unknown"))
    rows = dwd.withColumn("kind", event_kind()).where(F.col("uid").isNotNull() & F.col("kind").isin(*kinds))
    rows = rows.select("uid", column.alias("entity"), *ORDER, "kind")
    schema = "uid string, entity string, " + ", ".join(f"{k}_cnt double" for k in kinds) + ", last_ts long"
    return rows.groupBy("uid").transformWithStateInPandas(DecayedCounts(kinds), schema, "Update", "None")


FLUSHED_OUT = "key string, members array<string>, times array<long>, last_ts long, flushed_at long"


class FlushedSequence(StatefulProcessor):
    """The newest ``n`` members of a key, handed out when the key's own timer fires.

    The first row after a flush sets the timer; rows until then only change the state. So a busy key is written
    once per ``flush_ms``, and an idle key not at all.
    """

    def __init__(self, n: int, flush_ms: int):
        self.n, self.flush_ms = n, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "member string", "ts long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.members.iterator()}
        kept = dict(before)
        for pdf in rows:
            for member, ts in pdf.groupby("member")["ts"].max().items():
                kept[member] = max(kept.get(member, int(ts)), int(ts))
            kept = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]), reverse=True)[: self.n])
        for member in before.keys() - kept.keys():
            self.members.removeKey((member,))
        for member, ts in kept.items():
            if before.get(member) != ts:
                self.members.updateValue((member,), (ts,))
        if not self.due.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.flush_ms
            self.handle.registerTimer(at)
            self.due.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        newest = sorted(((v[0], k[0]) for k, v in self.members.iterator()), reverse=True)
        yield pd.DataFrame(
            {
                "key": [key[0]],
                "members": [[m for _, m in newest]],
                "times": [[t for t, _ in newest]],
                "last_ts": [newest[0][0]],
                "flushed_at": [timerValues.getCurrentProcessingTimeInMs()],
            }
        )

    def close(self) -> None:
        pass


def flushed_sequence_stream(events: DataFrame, n: int, flush_ms: int = 500) -> DataFrame:
    """(key, members, times, last_ts, flushed_at) of (key, member, ts) rows: a row whenever the timer of a key fires."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("member").cast("string").alias("member"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(FlushedSequence(n, flush_ms), FLUSHED_OUT, "Update", "ProcessingTime")
