"""Logs, job states, request rates and board upserts."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline import fixed
from slotline.operators.order import row_numbers
from slotline.session import stage


def recent_rows(df: DataFrame, time: str, n: int, tie_break: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie_break)).limit(n)


def activity_feed(audit: DataFrame, requests: DataFrame, n: int = 20) -> DataFrame:
    """Audit events and requests in one shape, newest ``n``.

    Each log is cut to ``n`` before the union: no older row can be among the newest n.
    """
    events = recent_rows(
        audit.select(
            F.lit("audit").alias("source"),
            "created_at",
            F.col("event_type").alias("title"),
            F.col("payload_json").alias("summary"),
            F.col("event_id").cast("string").alias("entry_id"),
        ),
        "created_at",
        n,
        "entry_id",
    )
    calls = recent_rows(
        requests.select(
            F.lit("api").alias("source"),
            "created_at",
            F.format_string("%s %s", "method", "path").alias("title"),
            F.format_string(
                "status=%d duration_ms=%.2f", F.col("status_code"), F.rint(F.col("duration_ms") * 100) / 100
            ).alias("summary"),
            F.col("request_id").cast("string").alias("entry_id"),
        ),
        "created_at",
        n,
        "entry_id",
    )
    return (
        events.unionByName(calls)
        .orderBy(F.desc("created_at"), "source", F.desc("entry_id"))
        .limit(n)
    )


def job_state(events: DataFrame, tie_break: str | None = None) -> DataFrame:
    """Fold job events into one row per job; a later update overwrites an earlier one."""
    order = F.struct("at", *([tie_break] if tie_break else []))
    moment = lambda *names: F.max(F.when(F.col("status").isin(*names), F.col("at")))
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.min("at").alias("created_at"),
        moment("running").alias("started_at"),
        moment("completed", "failed").alias("finished_at"),
        F.max_by("message", order).alias("message"),
    )


def upsert_latest(board: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Board after a batch of changes: per key the newest row of both, as one aggregation."""
    columns = board.columns
    both = board.unionByName(changes.select(*columns))
    whole = F.struct(*[F.col(c) for c in columns])
    return (
        both.groupBy(key)
        .agg(F.max_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def offered_rate(
    requests: DataFrame,
    client: str = "client_host",
    time: str = "created_at",
    window_seconds: int = fixed.REQUEST_WINDOW_SECONDS,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Requests of the same client in the trailing window, the current instant included.

    Adds ``offered`` (all in the window) and ``earlier`` (strictly before the current instant). A request aged
    exactly the window has left it. Clients are split into time buckets; a request near the end of a
    bucket is also sent to the next one as context, so one busy client never has to fit into a task.
    Requests without a client are one client, the unknown; requests without a time have null counts.
    """
    rated = _rated(requests, client, time, window_seconds, bucket_seconds)
    none = F.lit(None).cast("long")
    untimed = requests.where(F.col(time).isNull()).select("*", none.alias("offered"), none.alias("earlier"))
    return rated.select(*requests.columns, "offered", "earlier").unionByName(untimed)


def _rated(requests: DataFrame, client: str, time: str, window_seconds: int, bucket_seconds: int) -> DataFrame:
    """Offered counts with the time bucket of each row and the newest burst start seen in the bucket."""
    if window_seconds > bucket_seconds:
        raise ValueError("a time bucket must be at least as long as the window")
    span, reach = bucket_seconds * 1_000_000, window_seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    home = F.floor(F.col("_us") / F.lit(span)).cast("long")
    rows = (
        requests.where(F.col(time).isNotNull())
        .select("*", at.alias("_us"), F.coalesce(F.col(client).cast("string"), F.lit(fixed.UNKNOWN_CLIENT)).alias("_client"))
        .withColumn("_home", home)
        .withColumn(
            "_bucket",
            F.explode(
                F.when(
                    F.col("_us") + reach > (F.col("_home") + 1) * span,
                    F.array("_home", F.col("_home") + 1),
                ).otherwise(F.array("_home"))
            ),
        )
    )
    order = Window.partitionBy("_client", "_bucket").orderBy("_us")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    # Differences of running counts: a sliding frame would look at the whole window again for every row.
    seen = lambda shift: F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, shift))
    return (
        rows.withColumns({"offered": seen(0) - seen(-reach), "earlier": seen(-1) - seen(-reach)})
        .where(F.col("_bucket") == F.col("_home"))
        .withColumn("_start", F.max(F.when(F.col("earlier") == 0, F.col("_us"))).over(upto))
        .drop("_home")
    )


BLOCK = 50_000  # rows that one task replays at a time
SPAN = 100  # blocks whose starts one task works out at a time, from instants alone
TRIES = 3  # rounds in which spans behind an unsettled one are worked out as well


def _replay(times, groups, start: list[int], limit: int, reach: int) -> tuple[list, list, list, list[int]]:
    """Admit sorted requests while fewer than ``limit`` admitted ones are in the window: (allowed, remaining, retry_after, instants left at the end).

    ``start`` holds the admitted instants in the window of the first group; every other group starts from nothing.
    """
    current, admitted = (groups[0] if len(groups) else None), deque(start)
    ok, left, wait = [], [], []
    for group, now in zip(groups, times):
        if group != current:
            current, admitted = group, deque()
        while admitted and now - admitted[0] >= reach:
            admitted.popleft()
        if len(admitted) >= limit:
            ok.append(False)
            left.append(0)
            wait.append(max(1, (reach - (now - admitted[0])) // 1_000_000))
        else:
            admitted.append(now)
            ok.append(True)
            left.append(limit - len(admitted))
            wait.append(0)
    return ok, left, wait, [int(x) for x in admitted]


def _window_after(times: np.ndarray, start: list[int], limit: int, reach: int) -> list[int]:
    """Admitted instants in the window at the end of one burst's sorted ``times``: what ``_replay`` leaves, found by jumps over what is denied."""
    admitted, at = deque(start), 0
    while at < len(times):
        if len(admitted) >= limit:
            if times[at] - admitted[0] < reach:
                at += int(np.searchsorted(times[at:], admitted[0] + reach))
                continue
            admitted.popleft()
        admitted.append(int(times[at]))
        at += 1
    return [x for x in admitted if times[-1] - x < reach]


def _replayed(busy: DataFrame, keep: list[str], schema: T.StructType, order: list[str], limit: int, reach: int) -> DataFrame:
    """Overloaded bursts replayed in blocks of ``BLOCK`` rows, whatever client they belong to.

    A block's end depends on its start only if the block lies within one burst; such a block is one row with its instants. The starts of ``SPAN``
    blocks are worked out at a time, which takes a search per admitted request. Every span first begins with an empty window, all at once; its end is
    then the start of the next one if that goes on with the same burst, and spans whose start turns out to be another than assumed are done again until no
    start changes. A lull makes an end independent of the start, so a change seldom travels far; with none it travels a span per round, and after
    ``TRIES`` rounds only the spans that it has reached are done again. Then all blocks are replayed, each once.
    """
    numbered = row_numbers(busy, [F.col(c) for c in order])
    blocks = numbered.withColumn("_block", F.floor(F.col("row_no") / BLOCK).cast("long"))
    blocks = stage(blocks.withColumn("_group", F.concat_ws("\0", "_client", F.col("_burst").cast("string"))), "blocks")

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no")
        groups, times = rows["_group"].to_numpy(), rows["_us"].to_numpy("int64")
        head, tail = groups[0], groups[-1]
        end = None if head == tail else _window_after(times[groups == tail], [], limit, reach)
        return pd.DataFrame({"_block": [rows["_block"].iloc[0]], "_head": [head], "_tail": [tail], "_known": [end], "_times": [times.tobytes() if head == tail else None]})

    told = blocks.select("_block", "row_no", "_group", "_us").groupBy("_block").applyInPandas(tell, "_block long, _head string, _tail string, _known array<long>, _times binary")
    told = stage(told.withColumn("_span", F.floor(F.col("_block") / SPAN).cast("long")), "told")
    states = "_span long, _block long, _head string, _tail string, _start array<long>, _end array<long>"

    def follow(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        start = list(first["_start"].iloc[0]) if len(first) else []
        for row in rows.sort_values("_block").itertuples(index=False, name=None):
            span, block, head, tail, end, times = row
            if before is not None and before != head:
                start = []
            end = list(end) if head != tail else _window_after(np.frombuffer(times, "int64"), start, limit, reach)
            out.append((span, block, head, tail, start, end))
            before, start = tail, end
        return pd.DataFrame(out, columns=["_span", "_block", "_head", "_tail", "_start", "_end"])

    def followed(rows: DataFrame, first: DataFrame) -> DataFrame:
        rows = rows.select("_span", "_block", "_head", "_tail", "_known", "_times")
        return rows.groupBy("_span").cogroup(first.groupBy("_span")).applyInPandas(follow, states)

    def changed_in(known: DataFrame) -> DataFrame:
        """(_span, _start) of the spans that begin otherwise than was assumed. From here on, tables have a row per block or fewer."""
        last = known.where((F.col("_block") + 1) % SPAN == 0)
        before = last.select((F.col("_block") + 1).alias("_block"), F.col("_tail").alias("_head"), F.col("_end").alias("_right"))
        first = known.where(F.col("_block") % SPAN == 0).join(before, ["_block", "_head"], "left")
        right = F.coalesce("_right", F.array().cast("array<long>"))
        return first.where(right != F.col("_start")).select("_span", right.alias("_start"))

    none = told.limit(0).select("_span", F.array().cast("array<long>").alias("_start"))
    known, tries = stage(followed(told, none), "known"), 0
    while True:
        changed, tries = stage(changed_in(known), "changed"), tries + 1
        if changed.isEmpty():
            break
        if tries > TRIES:
            changed = changed.join(changed.select((F.col("_span") + 1).alias("_span")), "_span", "left_anti")
        again = followed(told.join(F.broadcast(changed.select("_span")), "_span", "left_semi"), changed)
        known = stage(known.join(changed, "_span", "left_anti").unionByName(again), "known")

    def judge(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no")
        ok, left, wait, _ = _replay(rows["_us"].tolist(), rows["_group"].tolist(), list(states["_start"].iloc[0]), limit, reach)
        return rows[keep].assign(allowed=ok, remaining=left, retry_after=wait)

    return blocks.groupBy("_block").cogroup(known.select("_block", "_start").groupBy("_block")).applyInPandas(judge, schema)


def rate_admission(
    requests: DataFrame,
    limit: int = fixed.REQUEST_LIMIT,
    client: str = "client_host",
    time: str = "created_at",
    tie_break: str = "request_id",
    window_seconds: int = fixed.REQUEST_WINDOW_SECONDS,
) -> DataFrame:
    """Replay a sliding-window limiter in which only admitted requests count.

    A request with nothing in the window before it starts a burst with an empty limiter, so bursts are
    independent. A burst that never offers more than ``limit`` admits everything and stays in
    built-in operators. Only overloaded bursts are replayed in order, in blocks of bounded size with at
    most ``limit`` instants of state, so a hot client is shared by many tasks. Requests without a client are one client, the unknown; a request without
    a time is not judged (null in all three columns).
    """
    reach = window_seconds * 1_000_000
    bucket_seconds = max(3600, window_seconds)
    rated = _rated(requests, client, time, window_seconds, bucket_seconds)
    # A burst that began in an earlier bucket: one row per client and bucket is carried forward.
    before = Window.partitionBy("_client").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rated = stage(rated, "rated")
    carried = (
        rated.groupBy("_client", "_bucket")
        .agg(F.max("_start").alias("_last"))
        .select("_client", "_bucket", F.max("_last").over(before).alias("_carried"))
    )
    marked = (
        rated.join(carried, ["_client", "_bucket"], "left")
        .withColumn("_burst", F.coalesce("_start", "_carried"))
        .drop("_start", "_carried", "_bucket")
    )
    peers = Window.partitionBy("_client", "_burst", "_us").orderBy(tie_break)
    numbered = stage(marked.withColumn("_nth", F.col("earlier") + F.row_number().over(peers)), "numbered")
    load = numbered.groupBy("_client", "_burst").agg(F.max("offered").alias("_peak"))
    judged = numbered.join(load, ["_client", "_burst"])

    keep = requests.columns
    calm = judged.where(F.col("_peak") <= limit).select(
        *keep,
        F.lit(True).alias("allowed"),
        (F.lit(limit) - F.col("_nth")).cast("long").alias("remaining"),
        F.lit(0).cast("long").alias("retry_after"),
    )
    busy = judged.where(F.col("_peak") > limit).select(*keep, "_client", "_burst", "_us")
    none = F.lit(None)
    untimed = requests.where(F.col(time).isNull()).select(
        *keep, none.cast("boolean").alias("allowed"), none.cast("long").alias("remaining"), none.cast("long").alias("retry_after")
    )
    schema = T.StructType(
        [requests.schema[c] for c in keep]
        + [
            T.StructField("allowed", T.BooleanType()),
            T.StructField("remaining", T.LongType()),
            T.StructField("retry_after", T.LongType()),
        ]
    )
    replayed = _replayed(busy, keep, schema, ["_client", "_burst", "_us", tie_break], limit, reach)
    return calm.unionByName(replayed).unionByName(untimed)


def event_key(*parts: str | Column) -> Column:
    """A deterministic id: the same event gets the same id when a batch is replayed."""
    columns = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)
