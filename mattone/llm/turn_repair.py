"""Conversation structure repair: cheapest edits by a Viterbi search that runs in parallel pieces of a conversation.

A conversation's rows in order must read as ``(s?(ua)+)?`` by role initials. Each row is kept (0), given the role that
is due (3) or deleted (4; blank and repeated rows must go); empty user or assistant rows may be inserted anywhere (3 each);
a truncated row that stays adds 3. The automaton has four states (nothing yet, after system, after user, after assistant), and
from a state each edit leads to one state, so the edit letters (D, I, K, R) alone determine the repaired roles.

Rank-convergence parallel Viterbi: rows are put into a total order by one range shuffle and cut into chunks of at most ``CHUNK`` rows.
Every chunk computes its backward costs from a speculative vector at its end. Fix-up passes compare what a chunk assumed with what its
successor found: vectors that differ only by a constant are as good as equal, other chunks run again, until none does. Chunks
whose edits never bring two vectors together (long runs of unknown roles) are left after ``PASSES`` passes; their boundaries come from a
scan of 4 x 4 min-plus matrices in a logarithmic number of joins, exactly. The stitched backward costs then drive the
trace: from the entry state the least letter that stays on a cheapest path. Chunks trace from all four entry states at once, and a scan of
these maps tells which entry is the true one. Nothing of a conversation is gathered in one task but its edit letters.

Rules: null roles and texts count as one space. Rows are ordered by turn (nulls first), role, text; rows equal in all are
interchangeable. Null conversation ids are one conversation. A role without a first letter s, u or a (also the empty role) can't
be kept. Only id, turn, role and text are read, so further columns do no harm. An empty table gives empty results.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import cut_lineage

#: Rows of a chunk at most; a power of two.
CHUNK = 1024
#: Fix-up passes before the rest is settled by a scan.
PASSES = 3
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Where an inserted or relabelled row leads, and what it is.
DUE = (2, 2, 3, 2)
ROLE_OF = {1: "s", 2: "u", 3: "a"}
#: Costs from behind the last row: a user and an assistant are missing after system, an assistant after user.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
#: Faults of a row, in order of precedence after "none".
FAULTS = ("none", "blank", "duplicate", "truncated")
BLANK = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key (of the conversation), pos (grows along the order), written once."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # The last key splits rows that are equal in all others, so no range is larger than the rest.
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    # Partition number above, place in the sorted partition below: along ranges the number only grows.
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return cut_lineage(rows.select("conv_id", "turn", "role", "text", key.alias("key"), "pos"))


def faults(rows: DataFrame) -> DataFrame:
    """key, pos, letter (s, u, a or x) and fault (0 none, 1 blank, 2 duplicate, 3 truncated) of each ordered row."""
    first = F.substring("role", 1, 1)
    seen = rows.select("key", "pos", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"), F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("letter"),
                       (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(FINISHED)).alias("open"))
    # The first of equal rows by a combined minimum and a join on the place: many copies meet in no task.
    leader = seen.groupBy("key", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("leads"))
    code = F.when(F.col("blank"), 1).when(F.col("leads").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    return seen.join(leader, "pos", "left").select("key", "pos", "letter", code.alias("fault"))


def chunks(marked: DataFrame) -> DataFrame:
    """key, chunk, codes (one character a row, in order), nth (chunk of its conversation, from 1), next (the chunk behind or null)."""
    code = F.substring(F.lit("abcdefghijklmnop"), (F.instr(F.lit("suax"), F.col("letter")) - 1) * 4 + F.col("fault") + 1, F.lit(1))
    packed = (marked.select("key", F.shiftright("pos", CHUNK.bit_length() - 1).alias("chunk"), F.struct("pos", code.alias("code")).alias("row")).groupBy("key", "chunk")
              .agg(F.array_sort(F.collect_list("row")).alias("rows")))  # at most CHUNK rows
    along = Window.partitionBy("key").orderBy("chunk")
    return cut_lineage(packed.select("key", "chunk", F.array_join(F.col("rows.code"), "").alias("codes"), F.col("rows")[0]["pos"].alias("start"),
                                     F.row_number().over(along).alias("nth"), F.lead("chunk").over(along).alias("next")))


def step(code: str, after: tuple) -> tuple:
    """Costs before a row from those behind it."""
    kind, fault = divmod(ord(code) - 97, 4)
    stay = TRUNCATED if fault == 3 else 0
    gone = [DELETE + c for c in after]
    best = list(gone)
    if fault not in (1, 2):
        for state in range(4):
            due = DUE[state]
            best[state] = min(best[state], RELABEL + stay + after[due])
            if kind == due - 1 and kind > 0:  # u is 1 and leads to 2, a is 2 and leads to 3
                best[state] = min(best[state], stay + after[due])
        if kind == 0:
            best[0] = min(best[0], stay + after[1])
    user, assistant = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return (min(best[0], INSERT + user), min(best[1], INSERT + user), user, assistant)


def level(vector: tuple) -> tuple[tuple, int]:
    """The vector without its constant, and the constant."""
    low = min(vector)
    return tuple(min(c - low, FAR) for c in vector), low


def backward(codes: str, behind: tuple) -> tuple:
    for code in reversed(codes):
        behind = step(code, behind)
    return behind


def per_row(df: DataFrame, schema: str, of: Callable[[dict], dict]) -> DataFrame:
    """A function of one small row, in Arrow batches."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [of(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: row[n] for n in names} for row in out], schema=wanted)

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def scan(parts: DataFrame, combine: Callable[[list, list], list], backwards: bool) -> DataFrame:
    """Running combination of ``v`` along each key's ``nth``, from the end if ``backwards``; pairs of doubling distance."""
    most = parts.agg(F.max("nth")).first()[0] or 0
    span = 1
    while span < most:
        other = parts.select("key", (F.col("nth") - span if backwards else F.col("nth") + span).alias("nth"), F.col("v").alias("w"))
        parts = cut_lineage(per_row(parts.join(other, ["key", "nth"], "left"), "key string, nth int, v array<bigint>",
                                    lambda row: row | {"v": row["v"] if row["w"] is None else combine(row["v"], row["w"])}))
        span *= 2
    return parts


def product(first: list, then: list) -> list:
    """Min-plus product of 4 x 4 matrices by rows."""
    return [min(FAR, min(first[4 * i + k] + then[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]


def matrix(codes: str) -> list:
    """Entry (i, j): cost of the chunk from state i to state j."""
    columns = [backward(codes, tuple(0 if s == j else FAR for s in range(4))) for j in range(4)]
    return [min(FAR, columns[j][i]) for i in range(4) for j in range(4)]


RUN = "key string, chunk bigint, nth int, next bigint, codes string, start bigint, assumed array<bigint>, found array<bigint>, added bigint"


def searched(row: dict, assumed: tuple) -> dict:
    found, added = level(backward(row["codes"], assumed))
    return row | {"assumed": list(assumed), "found": list(found), "added": added}


def settled(pieces: DataFrame) -> DataFrame:
    """Chunks with the true costs behind them (``assumed``, less a constant), before them (``found``) and the constant added."""
    end = level(END)[0]
    runs = cut_lineage(per_row(pieces, RUN, lambda row: searched(row, end)))  # last chunks start from the truth, others speculate
    several = runs.where("next IS NOT NULL").limit(1).count() > 0
    passes = 0
    while several:
        found = runs.select("key", F.col("chunk").alias("next"), F.col("found").alias("behind"))
        wrong = runs.join(found, ["key", "next"]).where("behind <> assumed")
        wrong = cut_lineage(wrong)
        if not wrong.limit(1).count():
            break
        if passes == PASSES:
            return by_matrices(runs, wrong)
        again = per_row(wrong, RUN, lambda row: searched(row, tuple(row["behind"])))
        runs = cut_lineage(runs.join(wrong.select("key", "chunk"), ["key", "chunk"], "left_anti").select(again.columns).union(again))
        passes += 1
    return runs


def by_matrices(runs: DataFrame, wrong: DataFrame) -> DataFrame:
    """All chunks of the conversations that don't converge, from the matrices of what follows each of them."""
    keys = wrong.select("key").distinct()
    left = cut_lineage(runs.join(keys, "key", "left_semi"))
    mats = cut_lineage(per_row(left.select("key", "nth", "codes"), "key string, nth int, v array<bigint>", lambda row: row | {"v": matrix(row["codes"])}))
    follows = scan(mats, product, backwards=True)
    behind = per_row(follows, "key string, nth int, v array<bigint>",
                     lambda row: {"key": row["key"], "nth": row["nth"] - 1, "v": list(level(tuple(min(row["v"][4 * i + j] + END[j] for j in range(4)) for i in range(4)))[0])})
    end = level(END)[0]
    again = per_row(left.join(behind, ["key", "nth"], "left"), RUN, lambda row: searched(row, end if row["v"] is None else tuple(row["v"])))
    return cut_lineage(runs.join(keys, "key", "left_anti").select(again.columns).union(again))


def traced(codes: str, behind: tuple, state: int, last: bool) -> tuple[list[tuple[str, str, str]], str, int]:
    """Per row (inserted roles, edit, role initial that stays), the roles inserted at the end, and the state reached."""
    after = [tuple(behind)]
    for code in reversed(codes):
        after.append(step(code, after[-1]))
    after.reverse()
    edits = []
    for place, code in enumerate(codes):
        kind, fault = divmod(ord(code) - 97, 4)
        stay = TRUNCATED if fault == 3 else 0
        inserted = ""
        while True:
            now, then, due = after[place][state], after[place + 1], DUE[state]
            if now == DELETE + then[state]:
                edits.append((inserted, "D", ""))
                break
            if now == INSERT + after[place][due]:
                state = due
                inserted += ROLE_OF[state]
                continue
            goes = 1 if kind == 0 and state == 0 else due if kind > 0 and kind == due - 1 and kind < 3 else None
            if goes and fault not in (1, 2) and now == stay + then[goes]:
                state = goes
                edits.append((inserted, "K", "suax"[kind]))
                break
            state = due
            edits.append((inserted, "R", ROLE_OF[state]))
            break
    tail = ""
    while last and END[state]:
        state = DUE[state]
        tail += ROLE_OF[state]
    return edits, tail, state


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations).

    rows: key, conv_id, pos, place, edit, role, text of each row that stays or is inserted, ordered by (pos, place).
    conversations: key, blank, duplicate, truncated, illegal, cost, audit, one row per conversation with rows.
    """
    rows = ordered(turns)
    done = settled(chunks(faults(rows)))
    long = done.where("nth > 1 OR next IS NOT NULL")
    maps = per_row(long.select("key", "nth", "codes", "assumed"), "key string, nth int, v array<bigint>",
                   lambda row: row | {"v": [traced(row["codes"], tuple(row["assumed"]), state, False)[2] for state in range(4)]})
    reached = scan(cut_lineage(maps), lambda mine, before: [mine[s] for s in before], backwards=False)
    entry = reached.select("key", (F.col("nth") + 1).alias("nth"), F.col("v")[0].alias("entry"))
    before = done.select("key", (F.col("nth") + 1).alias("nth"), F.substring("codes", -1, 1).alias("previous"))

    def told(row: dict) -> dict:
        edits, tail, _ = traced(row["codes"], tuple(row["assumed"]), row["entry"] or 0, row["next"] is None)
        audit = "".join("I" * len(inserted) + edit for inserted, edit, _ in edits) + "I" * len(tail)
        kinds = [(ord(code) - 97) // 4 for code in (row["previous"] or "") + row["codes"]]
        told_faults = [(ord(code) - 97) % 4 for code in row["codes"]]
        first = row["found"][0] if row["nth"] == 1 else 0
        return {"key": row["key"], "nth": row["nth"], "chunk": row["chunk"], "audit": audit, "cost": row["added"] + first, "tail": tail,
                "illegal": sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:])), "start": row["start"], "rows": len(row["codes"]),
                "blank": told_faults.count(1), "duplicate": told_faults.count(2), "truncated": told_faults.count(3),
                "edits": [f"{inserted}{edit}{role}" for inserted, edit, role in edits]}

    # A chunk's place in the order is its rows' places: they are consecutive from ``start``.
    out = cut_lineage(per_row(done.join(entry, ["key", "nth"], "left").join(before, ["key", "nth"], "left"),
                              "key string, nth int, chunk bigint, audit string, cost bigint, tail string, illegal bigint, start bigint, rows bigint, blank bigint, "
                              "duplicate bigint, truncated bigint, edits array<string>", told))
    total = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    conversations = out.groupBy("key").agg(*total, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    each = out.select("key", F.posexplode("edits").alias("i", "e"), "start").select((F.col("start") + F.col("i")).alias("pos"), "e")
    name = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))
    parts = F.regexp_extract("e", "^([ua]*)([DKR])([sua]?)$", 1), F.regexp_extract("e", "^([ua]*)([DKR])([sua]?)$", 2), F.regexp_extract("e", "^([ua]*)([DKR])([sua]?)$", 3)
    joined = rows.join(each, "pos").select("key", "conv_id", "pos", parts[0].alias("ins"), parts[1].alias("edit"), parts[2].alias("initial"), "role", "text")
    inserted = lambda roles: F.transform(F.filter(F.split(roles, ""), lambda r: r != ""), lambda r: F.struct(F.lit("I").alias("edit"), name[r].alias("role"), F.lit("").alias("text")))
    kept = F.when(F.col("edit") == "K", F.array(F.struct("edit", "role", "text"))).when(F.col("edit") == "R", F.array(F.struct("edit", name[F.col("initial")].alias("role"), "text")))
    kept = F.coalesce(kept, F.array().cast("array<struct<edit:string,role:string,text:string>>"))
    stays = joined.select("key", "conv_id", "pos", F.posexplode(F.concat(inserted(F.col("ins")), kept)).alias("place", "x"))
    tails = out.where("tail <> ''").select("key", (F.col("start") + F.col("rows") - 1).alias("pos"), "tail")
    ids = rows.join(tails, ["key", "pos"]).select("key", "conv_id", "pos", F.posexplode(inserted(F.col("tail"))).alias("place", "x"))
    ids = ids.withColumn("place", F.col("place") + (1 << 20))  # behind the row itself
    fixed = stays.unionByName(ids).select("key", "conv_id", "pos", "place", "x.edit", "x.role", "x.text")
    return fixed, conversations


def digests(fixed: DataFrame) -> DataFrame:
    """key, repaired_sha256: ``role:text`` of a conversation's rows joined by newlines, read as a stream."""
    lines = fixed.select("key", "pos", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("key").sortWithinPartitions("key", "pos", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, sums = [], []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        sums.append(state.hexdigest())
                    key, state = k, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])

    return lines.mapInArrow(run, "key string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The given rows with faults planted by crc32 of ``conv_id:turn``: dropped, emptied, cut of stops, repeated, given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def gaps(turns: DataFrame) -> DataFrame:
    """key, gaps: turns missing between a conversation's lowest and highest."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    each = turns.select(key.alias("key"), "turn").distinct()
    return each.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))


def report(given: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conversation of ``given``: faults of ``damaged``, cost and letters of its repair, digest of what it became."""
    fixed, conversations = repair(damaged)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    every = given.select("conv_id").distinct().withColumn("key", key)
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = every.join(gaps(damaged), "key", "left").join(conversations, "key", "left").join(digests(fixed), "key", "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counted], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
