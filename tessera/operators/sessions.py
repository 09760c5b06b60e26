"""Sessions, activity, quotas and caches over event tables, and table upkeep (upserts, anti-joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row a key, the one of the highest version; of equal versions the last one in the order of the other columns."""
    both = old.unionByName(new)
    rest = [F.desc(f.name) for f in both.schema if f.name not in key and not f.dataType.simpleString().startswith(("map", "variant"))]
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(version), *rest))
    return both.withColumn("rn", rank).where("rn = 1").drop("rn")


def unseen(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def session_name(thread: Column) -> Column:
    """A readable name of a thread id."""
    number = F.split(thread, "_")[1]
    other = F.concat(F.lit("会话 "), F.left(thread, F.lit(8)))
    return F.when(thread == "default", "默认会话").when(thread.startswith("session_"), F.when(number.rlike(r"^\d+$"), F.concat(F.lit("会话 "), number)).otherwise(other)).otherwise(other)


def restore_sessions(messages: DataFrame, thread: str, seq: str, payload: str) -> DataFrame:
    """One row a thread: checkpoints, first and last payload, twice the checkpoints as the message count."""
    rows = messages.groupBy(thread).agg(F.count("*").alias("checkpoints"), F.min_by(payload, F.struct(seq, payload)).alias("first"), F.max_by(payload, F.struct(seq, payload)).alias("last"))
    return rows.withColumn("message_count", F.col("checkpoints") * 2)


def last_n(messages: DataFrame, thread: str, seq: str, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(thread).orderBy(F.desc(seq)))
    return messages.withColumn("back", rank).where(F.col("back") <= n)


def last_of_role(messages: DataFrame, thread: str, seq: str, role: str, text: str, wanted: str) -> DataFrame:
    return messages.where(F.col(role) == wanted).groupBy(thread).agg(F.max_by(text, F.struct(seq, text)).alias(text))


def rolling_mean(events: DataFrame, order: list[str], value: str, n: int = 100, by: list[str] | None = None) -> DataFrame:
    """The mean of the last ``n`` values, within each of ``by``.

    Rows are numbered in the order of ``by`` and ``order`` by range partitions (a count a partition,
    added up), and dealt with their ``n - 1`` predecessors into blocks of numbers, so no task sorts
    the table or one key of it.
    """
    by = by or []
    numbered = number_rows(events, [*by, *order], "number")
    size = 50 * n
    own = F.floor(F.col("number") / size)
    also = F.floor((F.col("number") + n - 1) / size)  # the last rows of a block precede the next
    dealt = numbered.withColumn("block", F.explode(F.array_distinct(F.array(own, also))))
    w = W.partitionBy("block", *by).orderBy("number").rowsBetween(-(n - 1), 0)
    return dealt.withColumn("mean", F.avg(value).over(w)).where(F.col("block") == own).drop("block", "number")


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` checkpointed to the folder in ``spark.checkpoint.dir``; where that is unset, to a temporary one on a single machine, and an error on a cluster."""
    spark = rows.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        import tempfile

        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return rows.checkpoint()


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 in the order of the whole table, without one task for all rows."""
    placed = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    placed = placed.withColumn("here", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = _written(placed)  # both uses below must see the same partitions
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return placed.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("here")).drop("part", "here", "before")


def rank_rows(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Ranks from 1 within each of ``by`` in the ascending order of the columns ``order``; no key is sorted in one task."""
    numbered = number_rows(rows, [*by, *order], name)
    first = numbered.groupBy(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(by))).agg(F.min(name).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)]
    joined = numbered.join(first, same).withColumn(name, (F.col(name) - F.col("_first") + 1).cast("int"))
    return joined.select(*numbered.columns)


def runner_stats(events: DataFrame, failed: Column, by: str) -> DataFrame:
    """(by, total, failures, rate): counts and share of success in percent."""
    rows = events.groupBy(by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failures"))
    return rows.withColumn("rate", (F.col("total") - F.col("failures")) / F.col("total") * 100)


def epoch_quota(calls: DataFrame, by: str, ts: str, limit: int, window: str = "1 hour") -> DataFrame:
    """Calls and accepted calls in windows that start at whole multiples of their length."""
    rows = calls.groupBy(by, F.window(ts, window)["start"].alias("start")).agg(F.count("*").alias("calls"))
    return rows.withColumn("accepted", F.least("calls", F.lit(limit)))


def quota_report(used: DataFrame, limit: Column) -> DataFrame:
    share = F.when(limit == 0, 0.0).otherwise(F.col("used") / limit * 100)
    return used.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used"))).withColumn("share", share)


def _runs(keys) -> list[int]:
    """Where runs of equal values start in an Arrow column, and its end."""
    import numpy as np

    codes = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
    return [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else [0]


def window_exits(at, span: int):
    """For each call as the start of a window: the start of the last window that begins among the calls ``at`` (sorted) if windows follow one another from there."""
    import numpy as np

    n = len(at)
    here, step = np.arange(n), np.searchsorted(at, at + span, "right")
    last = np.where(step < n, step, here)
    while True:  # pointers double until each stands on the last start of its chain
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def anchored_quota(calls: DataFrame, by: str, ts: str, limit: int, seconds: float, order: list[str] | None = None) -> DataFrame:
    """Adds ``accepted``: windows start with the first call after the one before has ended.

    Whether a call starts a window depends on where the last one started. Calls are sorted into range
    partitions, so a key with many calls fills several blocks. Each block says, for whatever window may be open
    when it begins, which one is open when it ends: a step function with a step for each call of its first
    window at most, and few in fact, as windows that start apart soon fall together. One pass over these
    steps, a few rows a block, tells what each block begins with; then each block is walked by itself.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    order, span = order or [ts], int(seconds * 1_000_000)
    taken, names = {c.lower() for c in calls.columns}, {}
    for name in ("us", "part", "until", "used", "key", "block"):
        names[name] = "_" * next(k for k in range(1, 99) if "_" * k + name not in taken) + name
    us, part = names["us"], names["part"]
    rows = calls.withColumn(us, F.unix_micros(F.col(ts).cast("timestamp"))).repartitionByRange(F.col(by), F.col(us), *order)
    rows = _written(rows.withColumn(part, F.spark_partition_id()).sortWithinPartitions(by, us, *order))
    key = rows.schema[by].dataType.simpleString()
    key_type = to_arrow_schema(rows.select(by).schema)[0].type

    def steps(batches):
        """(key, part, n, low, until, start): with a window open until ``low`` or later (up to the next step), the last one of the block starts at its row ``start`` and is open ``until``; without ``until``, the one that was open still is."""
        held = []

        def emit():
            keys, at = pa.concat_arrays([b.column(0) for b in held]), np.concatenate([b.column(1).to_numpy() for b in held])
            mine, n = held[0].column(2)[0].as_py(), len(at)
            last = window_exits(at, span)
            reach = int(np.searchsorted(at, at[0] + span, "right"))
            first = last[: reach + 1]
            change = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            low = [None if j == 0 else int(at[j - 1]) for j in change.tolist()]
            out = [(keys[0].as_py(), mine, n, u, int(at[s]) + span, int(s)) for u, s in zip(low, first[change].tolist(), strict=True)]
            if reach == n:
                out.append((keys[0].as_py(), mine, n, int(at[-1]), None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "part", "n", "low", "until", "start"])

        for batch in batches:
            edges = _runs(batch.column(0))
            for low, high in zip(edges, edges[1:]):
                if held and held[0].column(0)[0].as_py() != batch.column(0)[low].as_py():
                    yield emit()
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield emit()

    def begins(batches):
        """(key, part, until, used): the window that is open when a block begins, and the calls in it so far."""
        state, block, chosen = None, None, None  # state: key, until, calls of the key, number of the call that started the window

        def close():
            nonlocal state
            k, n, until, start = chosen
            key_, open_until, before, first = state
            state = (key_, open_until if until is None else until, before + n, first if until is None else before + start)

        for batch in batches:
            out = []
            for k, p, n, low, until, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != (k, p):
                    if chosen:
                        close()
                    if state is None or state[0] != k:
                        state = (k, None, 0, 0)
                    block = (k, p)
                    out.append((k, p, state[1], state[2] - state[3]))
                if low is None or state[1] is not None and low <= state[1]:
                    chosen = (k, n, until, start)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (key_type, pa.int32(), pa.int64(), pa.int64()))], names=["key", "part", "until", "used"])

    found = rows.select(by, us, part).mapInArrow(steps, f"key {key}, part int, n long, low long, until long, start long")
    found = found.repartition("key").sortWithinPartitions("key", "part", F.asc_nulls_first("low"))
    opened = _written(found.mapInArrow(begins, f"key {key}, part int, until long, used long"))
    opened = opened.withColumnsRenamed({"key": names["key"], "part": names["block"], "until": names["until"], "used": names["used"]})
    dealt = rows.join(opened, (F.col(part) == F.col(names["block"])) & F.col(by).eqNullSafe(F.col(names["key"])))
    dealt = dealt.select(*calls.columns, us, part, names["until"], names["used"]).sortWithinPartitions(part, by, us, *order)
    out = T.StructType([*calls.schema.fields, T.StructField("accepted", T.BooleanType())])
    schema, key_at = to_arrow_schema(out), calls.columns.index(by)

    def walk(batches):
        block, until, used = None, None, 0
        for batch in batches:
            keys, (at, parts) = batch.column(key_at), (c.to_numpy() for c in batch.columns[-4:-2])
            edges = sorted({*_runs(keys), *(np.flatnonzero(np.diff(parts)) + 1).tolist()})
            accepted = np.zeros(len(at), bool)
            for low, high in zip(edges, edges[1:], strict=False):
                own = (keys[low].as_py(), int(parts[low]))
                if own != block:
                    block, until, used = own, batch.column(batch.num_columns - 2)[low].as_py(), batch.column(batch.num_columns - 1)[low].as_py()
                i = low
                while i < high:
                    if until is None or at[i] > until:
                        until, used = at[i] + span, 0
                    end = i + int(np.searchsorted(at[i:high], until, "right"))  # a call at the very end still counts to the window
                    free = max(0, limit - used)
                    accepted[i : min(end, i + free)] = True
                    used += end - i
                    i = end
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:-4], schema, strict=False)), pa.array(accepted)], schema=schema)

    return dealt.mapInArrow(walk, out)


def ttl_cache(calls: DataFrame, by: str, ts: str, query: str, seconds: int, order: list[str]) -> DataFrame:
    """Adds ``hit``: the call before, of the same key, asked the same within ``seconds``. Every call refreshes the entry."""
    w = W.partitionBy(by).orderBy(*order)
    seconds_of = lambda c: c.cast("timestamp").cast("double")
    age = seconds_of(F.col(ts)) - seconds_of(F.lag(ts).over(w))
    return calls.withColumn("hit", F.coalesce((F.lag(query).over(w) == F.col(query)) & (age <= seconds), F.lit(False)))


def apply_activity(sessions: DataFrame, activity: DataFrame, key: list[str], count: str = "message_count", seen: str = "updated_at") -> DataFrame:
    """Message counts and last times brought up to date with activity (key, n, at)."""
    more = activity.groupBy(*key).agg(F.sum("n").alias("n"), F.max("at").alias("at"))
    rows = sessions.join(more, key, "left")
    return rows.withColumns({count: F.coalesce(count, F.lit(0)) + F.coalesce("n", F.lit(0)), seen: F.coalesce("at", seen)}).drop("n", "at")


def gap_sessions(events: DataFrame, by: str, ts: str, minutes: int = 30) -> DataFrame:
    """(by, start, end, n) of runs of events without a longer gap."""
    s = F.session_window(ts, f"{minutes} minutes")
    return events.groupBy(by, s).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def session_list(sessions: DataFrame, by: str, key: str, count: str, seen: str, most: int = 10) -> DataFrame:
    """(by, listing): the newest sessions of each user as lines, and how many more there are."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(seen), key))
    line = F.concat(F.left(F.col(key).cast("string"), F.lit(8)), F.lit(": "), F.col(count).cast("string"), F.lit("条消息 | "), F.date_format(seen, "MM-dd HH:mm"))
    top = sessions.withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_rank", line.alias("line")))).alias("_lines"))
    rows = top.join(sessions.groupBy(by).agg(F.count("*").alias("_n")), by)
    more = F.when(F.col("_n") > most, F.format_string("... 还有 %d 个会话", F.col("_n") - most))
    return rows.select(by, F.concat_ws("\n", F.transform("_lines", lambda x: x["line"]), more).alias("listing"))


#: The roles of stored messages, by the kind of message.
STORED_ROLE = {"user": "human", "human": "human", "assistant": "ai", "ai": "ai", "tool": "tool"}


def stored_role(role: Column) -> Column:
    """The role under which a message is stored; NULL for kinds that are not."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in STORED_ROLE.items() for x in pair)), role)


def appended(messages: DataFrame, more: DataFrame, thread: str, seq: str, at: Column) -> DataFrame:
    """``messages`` and ``more`` (thread, seq, role, content, tool_name), numbered on behind the thread's last, with the time ``at``; messages of kinds that are not stored go."""
    last = messages.groupBy(thread).agg(F.max(seq).alias("_last"))
    rows = more.withColumn("role", stored_role(F.col("role"))).where("role IS NOT NULL").join(last, thread, "left")
    place = F.row_number().over(W.partitionBy(thread).orderBy(seq, "role", "content"))
    rows = rows.withColumns({seq: (F.coalesce(F.col("_last") + 1, F.lit(0)) + place - 1).cast(messages.schema[seq].dataType), "timestamp": at})
    return messages.unionByName(rows.select(*messages.columns))
