"""Repair of conversation structure at the least cost, with an audit of every edit.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. Its turns are kept, given another role or deleted, and empty
turns inserted, at stated costs; blank and repeated turns must go, truncated ones cost more when they stay. Of all cheapest repairs the one whose
audit (a letter for each edit: K, R, D, I) is the least in ASCII order is taken.

Turns are sorted by conversation and turn over all tasks, and each task reads its share as a stream. It cuts conversations into chunks
of at most ``CHUNK_TURNS`` turns and gives batches of them to a recursive DuckDB query. Each recursion advances one turn for all
conversations of the batch and keeps the least (cost, audit) of each grammar state. A conversation that lies in one chunk is finished
there. For others (long ones, and those on the border of two tasks) a chunk is solved from every state it can be entered in; a second pass
over these small tables picks each chunk's way, so a conversation of any length is shared by many tasks, and only its audit, a
letter a turn, comes together in one row. In a normal form with insertions just before kept turns no prefix of an audit is the beginning of
another over the same turns, so chunks can be compared by rank without holding the letters before them.

Equal turns of a conversation with the same number are one row with a count before they are sorted, and repeated turns are found by a table
of the contents that occur under several numbers, so no key of very many rows is a group of its own.

Defined results: null role or text is one space; null turn numbers come first; turns of one number are in order of role and text; a null
conversation is a conversation; one without turns has an empty audit and zeros; repeated rows are repeated turns; very long texts are
taken whole; an empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from skeinlog.llm._memory import released
from skeinlog.llm._tables import write_table

CHUNK_TURNS = 256
#: Turns, and bytes, that a task gathers for one run of the query.
BATCH_TURNS, BATCH_BYTES = 8192, 32 << 20
#: Fixed: what counts as space, and what ends a sentence.
SPACE, ENDS = r"\x20\x09-\x0D", ".!?"
#: Grammar of role initials: state 0 is the start, 1 after s, 2 after u, 3 after a; a conversation may end in 0 or 3.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, STATES, KINDS = (0, 3), 4, "sua"
OTHER, GONE = 3, 4
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self) -> None:
        if self.insert <= 0:
            raise ValueError("an insertion must cost something")


def _step(state: int, initial: str) -> int | None:
    return GRAMMAR.get((state, initial))


def insertions(state: int) -> Iterator[tuple[int, str]]:
    """States that insertions reach from a state, with their letters; two are enough to reach every one."""
    for n in range(3):
        yield state, "I" * n
        state = next(t for c in ROLES if (t := _step(state, c)) is not None)


def moves(costs: Costs) -> pa.Table:
    """What one turn of a kind (0 to 2 for s, u, a; other; gone) can do in a state: the next state, price, letters, and whether it stays."""
    rows = [(q, GONE, q, 0, "", False) for q in range(STATES)]
    for q in range(STATES):
        for kind in range(4):
            rows.append((q, kind, q, costs.delete, "D", False))
            for at, letters in insertions(q):
                price = costs.insert * len(letters)
                if kind < OTHER and (to := _step(at, KINDS[kind])) is not None:
                    rows.append((q, kind, to, price + costs.keep, letters + "K", True))
                for c in ROLES:
                    if (to := _step(at, c)) is not None:
                        rows.append((q, kind, to, price + costs.rerole, letters + "R", True))
    names = ["state", "kind", "target", "price", "letters", "stays"]
    return pa.table({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


_QUERY = """
WITH RECURSIVE best(chunk, entry, state, i, cost, audit) USING KEY (chunk, entry, state) AS (
  SELECT chunk, entry, entry, 0::BIGINT, 0::BIGINT, '' FROM heads
  UNION
  SELECT chunk, entry, state, i, least.c, least.a FROM (
    SELECT b.chunk, b.entry, m.target AS state, s.i,
      min({'c': b.cost + m.price + CASE WHEN m.stays THEN s.late ELSE 0 END + s.dels * $delete,
           'a': b.audit || m.letters || repeat('D', s.dels)}) AS least
    FROM best b JOIN steps s ON s.chunk = b.chunk AND s.i = b.i + 1
      JOIN moves m ON m.state = b.state AND m.kind = s.kind
    GROUP BY ALL))
SELECT chunk, entry, state, cost, audit FROM best JOIN ends USING (chunk, i) ORDER BY ALL
"""


class Solver:
    """The recursive query over batches of chunks; one connection for a task."""

    def __init__(self, costs: Costs) -> None:
        import duckdb

        self.costs = costs
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        self.con.execute("SET temp_directory = ''")
        self.con.register("moves", moves(costs))

    def solve(self, chunk: np.ndarray, i: np.ndarray, kind: np.ndarray, late: np.ndarray, dels: np.ndarray, entries: list[tuple[int, int]], lengths: list[int]) -> list[dict]:
        """For each chunk {(entry, exit): (cost, audit)}. Turns are numbered from 1 within their chunk."""
        steps = {"chunk": chunk, "i": i, "kind": kind, "late": late, "dels": dels}
        tables = {
            "steps": pa.table({n: pa.array(x, pa.int64()) for n, x in steps.items()}),
            "heads": pa.table({"chunk": pa.array([c for c, _ in entries], pa.int64()), "entry": pa.array([e for _, e in entries], pa.int64())}),
            "ends": pa.table({"chunk": pa.array(range(len(lengths)), pa.int64()), "i": pa.array(lengths, pa.int64())}),
        }
        for name, table in tables.items():
            self.con.register(name, table)
        out: list[dict] = [{} for _ in lengths]
        for c, entry, state, cost, audit in self.con.execute(_QUERY, {"delete": self.costs.delete}).fetchall():
            out[c][entry, state] = cost, audit
        for name in tables:
            self.con.unregister(name)
        return out


def closing(state: int, costs: Costs) -> tuple[int, str]:
    """The cheapest way to end in this state."""
    return min((costs.insert * len(letters), letters) for at, letters in insertions(state) if at in FINAL)


def apply(audit: str, state: int, turns: list[tuple[str, str, bool, int]]) -> list[dict]:
    """The repaired turns. ``turns`` holds role, text, whether a copy may stay, and how many more must go."""
    out, letters = [], iter(audit)

    def put(role: str, text: str) -> None:
        nonlocal state
        state = _step(state, role[:1])
        out.append({"role": role, "text": text})

    def inserted() -> str:
        return next(ROLES[c] for c in ROLES if _step(state, c) is not None)

    for role, text, free, dels in turns:
        if free:
            while (edit := next(letters)) == "I":
                put(inserted(), "")
            if edit != "D":
                put(role if edit == "K" else inserted(), text)
        for _ in range(dels):
            next(letters)
    for _ in letters:
        put(inserted(), "")
    return out


# --- the turns of all conversations -------------------------------------------------------------------------


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, blank, late, again): equal turns of one number as one row with their number ``n``; ``again``
    says that an earlier number of the conversation has the same role and text. ``turns`` has (conv, turn, role, text, n);
    n = 0 marks a conversation without saying that it has a turn."""
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumns({
        "key": F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")),
        "blank": ~F.col("text").rlike(f"[^{SPACE}]"),
    }).withColumn("late", ~F.col("blank") & ~F.col("text").rlike(f"[{ENDS}][{SPACE}]*\\z"))
    rows = write_table(rows, "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn")))
    several = rows.where("n > 0 and not blank").groupBy("conv", "key").agg(F.count(F.lit(1)).alias("c"), first.alias("first")).where("c > 1")
    several = several.select(F.col("conv").alias("__conv"), F.col("key").alias("__key"), "first")
    own = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    joined = rows.join(several, (F.col("key") == F.col("__key")) & F.col("conv").eqNullSafe(F.col("__conv")), "left")
    return joined.select("conv", "turn", "role", "text", "n", "blank", "late", F.coalesce(own > F.col("first"), F.lit(False)).alias("again"))


#: Of a chunk: counts of faults and other marks that are summed, and what joins it to its neighbours.
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_BORDERS = T.StructType([T.StructField(n, t) for n, t in (("first", T.StringType()), ("last", T.StringType()), ("low", T.LongType()), ("high", T.LongType()))])


def _schema(conv: T.DataType) -> T.StructType:
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("free", T.BooleanType()), T.StructField("dels", T.LongType())])
    way = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    repaired = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return T.StructType([
        T.StructField("conv", conv), T.StructField("piece", T.LongType()), T.StructField("whole", T.BooleanType()),
        *(T.StructField(n, T.LongType()) for n in _COUNTS), T.StructField("borders", _BORDERS),
        T.StructField("ways", T.ArrayType(way)), T.StructField("rows", T.ArrayType(turn)),
        T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(repaired)),
    ])


def _kinds(roles: list[str], free: np.ndarray) -> np.ndarray:
    kind = np.array([KINDS.find(r[0]) if r else -1 for r in roles], np.int64)
    return np.where(free, np.where(kind < 0, OTHER, kind), GONE)


def _chunks(costs: Costs, schema: pa.Schema, chunk_turns: int, batch_turns: int):
    """Over turns sorted by conversation and number: a row for each chunk. Holds about one batch of turns and one open chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, task = Solver(costs), TaskContext.get().partitionId() << 32
        held: pa.Table | None = None
        made, opened = 0, True  # chunks so far; whether the first held conversation may have begun before

        def emit(table: pa.Table, bounds: list[tuple[int, int, bool]]) -> pa.RecordBatch:
            """bounds: from, to, and whether this is a whole conversation."""
            nonlocal made
            conv = table.column("conv").combine_chunks()
            roles, texts, turns = (table.column(c).to_pylist() for c in ("role", "text", "turn"))
            n, blank, late, again = (table.column(c).to_numpy() for c in ("n", "blank", "late", "again"))
            free = (n > 0) & ~blank & ~again
            dels = n - free
            lengths = [b - a for a, b, _ in bounds]
            chunk = np.repeat(np.arange(len(bounds)), lengths)
            i = np.concatenate([np.arange(1, m + 1) for m in lengths]) if lengths else np.zeros(0, np.int64)
            entries = [(c, e) for c, (_, _, whole) in enumerate(bounds) for e in (range(1) if whole else range(STATES))]
            solved = solver.solve(chunk, i, _kinds(roles, free), np.where(late, costs.truncated, 0), dels, entries, lengths)
            out = []
            for (a, b, whole), ways in zip(bounds, solved, strict=True):
                own = slice(a, b)
                there = [x for x in range(a, b) if n[x] > 0]
                initials = [roles[x][:1] for x in there]
                steps = sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:], strict=False))
                numbers = [turns[x] for x in there if turns[x] is not None]
                row = {
                    "piece": task + made, "whole": whole, "blank": int(n[own][blank[own]].sum()), "duplicate": int(dels[own][~blank[own]].sum()),
                    "truncated": int((late & free)[own].sum()), "illegal": steps + int((n[own][n[own] > 0] - 1).sum()), "turns": len(set(numbers)),
                    "borders": {"first": initials[0], "last": initials[-1], "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None} if there else None,
                    "ways": None, "rows": None, "cost": None, "audit": None, "repaired": None,
                }
                made += 1
                rows = [(roles[x], texts[x], bool(free[x]), int(dels[x])) for x in range(a, b)]
                if whole:
                    row["cost"], row["audit"] = min((c + closing(q, costs)[0], t + closing(q, costs)[1]) for (_, q), (c, t) in ways.items())
                    row["repaired"] = apply(row["audit"], 0, rows)
                else:
                    row["ways"] = [{"entry": e, "exit": q, "cost": c, "audit": t} for (e, q), (c, t) in sorted(ways.items())]
                    row["rows"] = [{"role": r, "text": t, "free": f, "dels": d} for r, t, f, d in rows]
                out.append(row)
            cells = [conv.take(pa.array([a for a, _, _ in bounds], pa.int64()))]
            cells += [pa.array([r[f.name] for r in out], f.type) for f in schema if f.name != "conv"]
            return pa.RecordBatch.from_arrays(cells, schema=schema)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Send what is held, but for the last conversation's open chunk if more may come."""
            nonlocal held, opened
            conv = held.column("conv").combine_chunks()
            new = np.ones(len(conv), bool)
            new[1:] = _differs(conv)
            starts = np.append(np.flatnonzero(new), len(conv)).tolist()
            bounds = []
            keep = len(conv)
            for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                end = k == len(starts) - 2
                cuts = list(range(a, b, chunk_turns))
                if end and not last:
                    keep = cuts.pop()  # its last chunk may grow
                whole = len(cuts) == 1 and not end and not (k == 0 and opened)
                bounds += [(x, min(x + chunk_turns, b), whole) for x in cuts]
            opened = opened and len(starts) == 2 or any(x == starts[-2] for x, _, _ in bounds)
            rest = held.slice(keep)
            if bounds:
                yield emit(held.slice(0, keep), bounds)
            held = rest

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            if held.num_rows >= batch_turns or held.nbytes > BATCH_BYTES:
                yield from cut(False)
        if held is not None and held.num_rows:
            yield from cut(True)

    return run


def _differs(conv: pa.Array) -> np.ndarray:
    """Where an entry (null for no id) is another than the one before."""
    if len(conv) < 2:
        return np.zeros(0, bool)
    a, b = conv.slice(0, len(conv) - 1), conv.slice(1)
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _ways(costs: Costs, schema: pa.Schema):
    """Over the open chunks of conversations, in order: by which entry and exit the cheapest repair passes each, and the insertions
    that end it. Holds a state's back pointers for each chunk of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back: list[tuple[int, dict[int, int]]] = []
        best: dict[int, tuple[int, int]] = {0: (0, 0)}  # state: (cost, rank of the audit so far)
        conv, begun = None, False

        def finished() -> pa.RecordBatch:
            # ranks of the audits so far break ties, and the closing letters follow the greater
            state = min(best, key=lambda q: (best[q][0] + closing(q, costs)[0], best[q][1]))
            tail, rows = closing(state, costs)[1], []
            for piece, came in reversed(back):
                rows.append((piece, came[state], state, tail))
                state, tail = came[state], ""
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([conv.take(pa.array([0] * len(rows))), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

        for batch in batches:
            changes = _differs(batch.column(0))
            pieces, ways = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                own = batch.column(0).slice(k, 1)
                if begun and (changes[k - 1] if k else _differs(pa.concat_arrays([conv, own]))[0]):
                    yield finished()
                    back, best = [], {0: (0, 0)}
                conv, begun = own, True
                found: dict[int, tuple] = {}
                for w in ways[k]:
                    if w["entry"] in best:
                        cost, rank = best[w["entry"]]
                        offer = cost + w["cost"], rank, w["audit"], w["entry"]
                        if w["exit"] not in found or offer < found[w["exit"]]:
                            found[w["exit"]] = offer
                back.append((pieces[k], {q: x[3] for q, x in found.items()}))
                order = {x: r for r, x in enumerate(sorted({x[1:3] for x in found.values()}))}
                best = {q: (x[0], order[x[1:3]]) for q, x in found.items()}
        if begun:
            yield finished()

    return run


def _resolve(insert: int, schema: pa.Schema):
    """Open chunks with their way: cost, audit and repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["ways", "rows", "entry", "exit", "tail"]).to_pylist()
            costs, audits, repaired = [], [], []
            for r in rows:
                way = next(w for w in r["ways"] if (w["entry"], w["exit"]) == (r["entry"], r["exit"]))
                costs.append(way["cost"] + insert * len(r["tail"]))
                audits.append(way["audit"] + r["tail"])
                repaired.append(apply(audits[-1], r["entry"], [(t["role"], t["text"], t["free"], t["dels"]) for t in r["rows"]]))
            new = {"cost": costs, "audit": audits, "repaired": repaired}
            cells = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return run


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),  # noqa: B008
    times: Column | None = None,
) -> DataFrame:
    """Conversations in pieces of at most ``CHUNK_TURNS`` different turns, in order of ``piece``: ``conv``, ``whole`` (the only piece), counts of
    faults, ``cost`` and ``audit`` of the piece, and its ``repaired`` turns. ``times`` says how often a row stands in its conversation (0: it only
    names the conversation)."""
    spark = turns.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = (F.lit(1) if times is None else times).cast("long").alias("n")
    there = lambda c, other: F.when(F.col("n") > 0, c).otherwise(other)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), n)
    rows = rows.select("conv", there(F.col("turn"), F.lit(None)).alias("turn"), there(F.col("role"), F.lit("")).alias("role"), there(F.col("text"), F.lit("")).alias("text"), "n")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    ordered = numbered_turns(rows).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv"].dataType
    schema = _schema(kind)
    run = _chunks(costs, to_arrow_schema(schema), CHUNK_TURNS, BATCH_TURNS)
    chunks = write_table(ordered.mapInArrow(released(run), schema), "conversation-chunks", compression="zstd")
    names = ["conv", "piece", "whole", *_COUNTS, "borders", "cost", "audit", "repaired"]
    part = chunks.where("not whole").select("conv", "piece", "ways")
    way = T.StructType([schema["conv"], T.StructField("piece", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("tail", T.StringType())])
    ways = part.repartition(partitions, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "piece").mapInArrow(released(_ways(costs, to_arrow_schema(way))), way)
    resolved = chunks.where("not whole").drop("cost", "audit", "repaired").join(ways.drop("conv"), "piece")  # pieces are numbered over all conversations
    done = T.StructType([schema[n] for n in names])
    resolved = resolved.mapInArrow(released(_resolve(costs.insert, to_arrow_schema(done))), done)
    return chunks.where("whole").select(*names).unionByName(resolved)


#: A conversation's summary: its sums, its audit, and a digest of its repaired turns.
_SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _spread(low, high, turns):
    return 0 if low is None else high - low + 1 - turns


def _summaries(schema: pa.Schema):
    """Over the pieces of conversations, in order: one row for each conversation. Holds one piece, and the audit of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def finished() -> pa.RecordBatch:
            gaps = _spread(state["low"], state["high"], state["turns"])
            cells = [gaps, *(state[n] for n in _SUMMARY[1:]), "".join(state["audit"]), state["hash"].hexdigest()]
            return pa.RecordBatch.from_arrays([conv, *(pa.array([c], f.type) for c, f in zip(cells, list(schema)[1:], strict=True))], schema=schema)

        for batch in batches:
            for k, r in enumerate(batch.drop_columns(["conv"]).to_pylist()):
                own = batch.column("conv").slice(k, 1)
                if conv is None or _differs(pa.concat_arrays([conv, own]))[0]:
                    if conv is not None:
                        yield finished()
                    conv, state = own, dict.fromkeys([*_COUNTS, "cost"], 0) | {"audit": [], "hash": hashlib.sha256(), "some": False, "last": None, "low": None, "high": None}
                for name in [*_COUNTS, "cost"]:
                    state[name] += r[name]
                state["audit"].append(r["audit"])
                for t in r["repaired"]:
                    state["hash"].update(("\n" if state["some"] else "").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                    state["some"] = True
                if (b := r["borders"]) is not None:
                    state["illegal"] += state["last"] is not None and state["last"] + b["first"] not in ("su", "ua", "au")
                    state["last"] = b["last"]
                    if b["low"] is not None:
                        state["turns"] -= state["high"] == b["low"]  # one number on both sides
                        state["low"], state["high"] = b["low"] if state["low"] is None else state["low"], b["high"]
        if conv is not None:
            yield finished()

    return run


def summarise(pieces: DataFrame) -> DataFrame:
    """``conv``, ``gaps`` and counts of faults, ``cost``, ``audit`` and ``repaired_sha256`` of each conversation of :func:`repair`."""
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    low, high = F.col("borders.low"), F.col("borders.high")
    whole = pieces.where("whole").select(
        "conv",
        F.when(low.isNull(), 0).otherwise(high - low + 1 - F.col("turns")).cast("long").alias("gaps"),
        *_SUMMARY[1:],
        "audit",
        F.sha2(F.array_join(F.transform("repaired", line), "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    schema = T.StructType([pieces.schema["conv"], *(T.StructField(n, T.LongType()) for n in _SUMMARY), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    rest = pieces.where("not whole").drop("whole").repartition(partitions, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "piece")
    return whole.unionByName(rest.mapInArrow(released(_summaries(to_arrow_schema(schema))), schema))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times) with stated faults: by a checksum of conversation and turn a row in twenty is dropped (times 0), one
    loses its text, one its sentence ends, one is repeated (times 2), and one is given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text, role = said(text_col), said(role_col)
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
