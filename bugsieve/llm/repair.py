"""Conversation structure repair by dynamic programming over grammar-compressed fault sequences.

A sound conversation's role initials read ``(s?(ua)+)?``.  Rows are edited: Keep costs 0, Rerole to
user or assistant 2, Delete 3, Insert of an empty turn 2; a blank or duplicate row must be
deleted, a truncated one that stays costs 1 more.  Wanted are the cheapest edits, written as their
initials; among equally cheap ones the ASCII-least text, the *audit*.

Every row becomes a symbol (role initial and fault), every conversation a sequence of symbols,
and equal sequences are one row of a table.  Rounds of Re-Pair over that table replace the most
frequent pairs of neighbours by rules; a round is one aggregation of pair counts.  A symbol has a
min-plus matrix over the four states of the pattern: from state to state the least cost and the
audit of getting there.  A rule's matrix is the product of its two sides', its audits are ropes that share the
sides' ropes, and rules are evaluated once, bottom-up, for all conversations.  A sequence is then the
product of the few matrices it compresses to.

Two equally cheap audits of one stretch between the same states never begin with one another:
they have the same number of letters other than ``I``, and more ``I`` at the end would cost more.
So the least text of a whole is made of least texts of its parts.

Plan: rows travel without their texts (a hash stands for it), range-sorted, and are cut into blocks
of at most ``BLOCK_ROWS`` rows, so a conversation that holds a third of all rows is many blocks.
What such a conversation needs in one row is 32 small numbers per block: the costs and the order of
the audits.  Texts move once, to be put together in order with their edits; that streams through a
task and holds a batch.  A digest of one conversation reads its rows in order, one after another.

Cases: a null conversation id, role or text, and a null turn in the damage key, read as one space.
Null conversation ids are one conversation, with a null id in the result.  Rows of one turn
stand in order of role, then SHA-256 of the text; null turns come first.  Repeated rows stand next
to each other: the later ones are duplicates.  An empty role has no initial and fits nowhere; it can be reroled.
An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugsieve.llm.common import BLANKS
from bugsieve.session import cut_lineage, ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STATES = 4  # nothing yet, after s, after u, after a; the first and last may end a conversation
#: What role comes next in a state, and the state after it.
_NEXT = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Inserts that lead from a state to an end.
_TAIL = [0, 2, 1, 0]
LEGAL = ("su", "ua", "au")
#: Rows by role initial, in capitals if truncated; X is a row that must go.
SYMBOLS = "suaoSUAOX"
_FIRST_RULE = 0x100
BLOCK_ROWS = 1024
ROUNDS = 12
PAIRS_A_ROUND = 32
_POSITION_BITS = 33


# --- the grammar and its matrices -------------------------------------------------------------


class Rope:
    """Two texts after one another, not copied."""

    __slots__ = ("left", "right")

    def __init__(self, left: Rope | str, right: Rope | str):
        self.left, self.right = left, right


def spelled(rope: Rope | str) -> str:
    parts, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo += (x.right, x.left)
    return "".join(parts)


Matrix = list[list[tuple[int, Rope | str] | None]]


def _better(a: tuple | None, b: tuple) -> tuple:
    if a is None or b[0] < a[0]:
        return b
    if b[0] > a[0] or a[1] is b[1]:
        return a
    return b if spelled(b[1]) < spelled(a[1]) else a


def symbol_matrix(symbol: str) -> Matrix:
    """From state to state over one row: inserts before it, then the row's own edit."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    late = TRUNCATED if symbol in "SUAO" else 0
    for p in range(STATES):
        m = p
        for n in range(3):
            edits = [(DELETE, "D", m)]
            if symbol != "X":
                edits.append((REROLE + late, "R", _NEXT[m][1]))
                if (m, symbol.lower()) in _KEPT:
                    edits.append((KEEP + late, "K", _KEPT[m, symbol.lower()]))
            for cost, letter, q in edits:
                out[p][q] = _better(out[p][q], (n * INSERT + cost, "I" * n + letter))
            m = _NEXT[m][1]
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        for q in range(STATES):
            best, ways = None, []
            for m in range(STATES):
                x, y = a[p][m], b[m][q]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best:
                    best, ways = cost, [(x[1], y[1])]
                elif cost == best:
                    ways.append((x[1], y[1]))
            found = None
            for x, y in ways:
                found = _better(found, (best, Rope(x, y)))
            out[p][q] = found
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """Of a sequence, halves first, so that ropes stay shallow."""
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[2 * len(pairs) :]
    return matrices[0]


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """The matrix of every symbol and, bottom-up, of every rule."""
    made = {x: symbol_matrix(x) for x in SYMBOLS}
    for k, (left, right) in enumerate(rules):
        made[chr(_FIRST_RULE + k)] = times(made[left], made[right])
    return made


def compressed(symbols: str, rules: list[tuple[str, str]]) -> str:
    for k, (left, right) in enumerate(rules):
        symbols = symbols.replace(left + right, chr(_FIRST_RULE + k))
    return symbols


def pair_counts(symbols: str) -> Counter:
    """Neighbours, counted as often as they can be replaced."""
    found = Counter(map(str.__add__, symbols, symbols[1:]))
    for run in re.finditer(r"(.)\1\1+", symbols, re.S):
        n = run.end() - run.start()
        found[run[1] * 2] -= n - 1 - n // 2
    return found


def grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS_A_ROUND) -> list[tuple[str, str]]:
    """Re-Pair rules of the distinct sequences ``(symbols, n)``, most frequent pairs first.

    A round takes the most frequent pairs that share no symbol, so that the order of their
    replacement does not matter; it stops when no pair comes twice.  At most ``rounds * pairs`` rules.
    """
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        now = list(rules)

        def count(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch["symbols"].to_pylist(), batch["n"].to_pylist()):
                    for pair, k in pair_counts(compressed(symbols, now)).items():
                        total[pair] += k * n
            yield pa.RecordBatch.from_pydict(
                {"pair": list(total), "n": list(total.values())}, schema=pa.schema([("pair", pa.string()), ("n", pa.int64())])
            )

        found = sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = found.filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * pairs).collect()
        taken: set[str] = set()
        for r in top:
            if not taken & set(r["pair"]) and len(rules) - len(now) < pairs:
                rules.append((r["pair"][0], r["pair"][1]))
                taken |= set(r["pair"])
        if len(rules) == len(now):
            break
    return rules


_MATRIX = (
    "symbols string, alone_cost long, alone_audit string, costs array<long>, ranks array<int>, audits array<string>"
)


def evaluated(sequences: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The matrix of every distinct sequence.

    ``costs``, ``ranks`` and ``audits`` run over start and end state; an end that cannot be reached costs -1;
    ``ranks`` orders the audits of one start.  ``alone`` is the answer if the sequence is the whole conversation.
    """
    made = rule_matrices(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols in batch["symbols"].to_pylist():
                m = product([made[x] for x in compressed(symbols, rules)])
                costs = [-1 if e is None else e[0] for row in m for e in row]
                audits = ["" if e is None else spelled(e[1]) for row in m for e in row]
                ranks = []
                for p in range(STATES):
                    mine = audits[STATES * p : STATES * (p + 1)]
                    ranks += [sorted(mine).index(x) for x in mine]
                cost, path, tail = walk([(costs, ranks)])
                audit = audits[path[0][1]] + "I" * tail
                out.append((symbols, cost, audit, costs, ranks, audits))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [c.split()[0] for c in _MATRIX.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
    return sequences.select("symbols").mapInArrow(run, _MATRIX)


def walk(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """Least cost of a row of blocks, ``(start, entry)`` of each, and the inserts at the end."""
    togo = [[INSERT * n for n in _TAIL]]
    for costs, _ in reversed(blocks):
        after = togo[-1]
        togo.append(
            [
                min((costs[STATES * p + q] + after[q] for q in range(STATES) if costs[STATES * p + q] >= 0))
                for p in range(STATES)
            ]
        )
    togo.reverse()
    p, path = 0, []
    for (costs, ranks), after in zip(blocks, togo[1:]):
        ends = [(costs[e := STATES * p + q] + after[q], ranks[e], q) for q in range(STATES) if costs[STATES * p + q] >= 0]
        q = min(ends)[2]
        path.append((p, STATES * p + q))
        p = q
    return togo[0][0], path, _TAIL[p]


# --- rows, faults and blocks ------------------------------------------------------------------


def named(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, conv_id, turn, role, text, copies)``: one row per turn, nulls as one space."""
    space = F.lit(" ")
    return turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_id}`").cast("string")), F.lit("")).alias("key"),
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`"), space).alias("text"),
        F.lit(1).alias("copies"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Damage of ``named`` rows, by the CRC-32 of conversation and turn: of twenty, one is dropped, one
    emptied, one loses its end marks, one is repeated and one becomes the user's."""
    spell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spell("conv_id"), F.lit(":"), spell("turn"))) % 20
    # The generator keeps the kind in a column of its own.
    drawn = rows.withColumn("_kind", F.explode(F.array(kind))).filter("_kind <> 0")
    return drawn.select(
        "key",
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("_kind") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"),
    )


def _text_hash(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def _order() -> list[Column]:
    """The order of a conversation's rows."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]


def placed_rows(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones counted in ``n``, with faults; ``at`` orders the table."""
    bare = F.btrim("text", F.lit(BLANKS))
    marks = rows.select(
        "key", "turn", "role", _text_hash().alias("h"), "copies",
        (F.length(bare) == 0).alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    counted = marks.groupBy("key", "turn", "role", "h", "blank", "cut").agg(F.sum("copies").alias("n"))
    placed = cut_lineage(counted.orderBy("key", *_order()).withColumn("at", F.monotonically_increasing_id()))
    again = (
        placed.groupBy("key", "role", "h").agg(F.min("at").alias("first_at"), F.count("*").alias("_n")).filter("_n > 1")
    )
    seen = F.coalesce(F.col("at") > F.col("first_at"), F.lit(False))
    return placed.join(again.drop("_n"), ["key", "role", "h"], "left").select(
        "key", "turn", "role", "at", "n", "blank", "cut", (seen & ~F.col("blank")).alias("seen")
    )


def fault_counts(marked: DataFrame) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated)`` from ``placed_rows``."""
    n = F.col("n")
    sums = {
        "blank": F.when(F.col("blank"), n).otherwise(0),
        "duplicate": F.when(F.col("blank"), 0).when(F.col("seen"), n).otherwise(n - 1),
        "truncated": (F.col("cut") & ~F.col("blank") & ~F.col("seen")).cast("long"),
    }
    by_turn = marked.groupBy("key", "turn").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("key").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(k).cast("long").alias(k) for k in sums]
    )


def _pairs(left: Column, right: Column) -> Column:
    return F.concat(left, right).isin(*LEGAL)


def blocks_of(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, at, symbols, first, last, n, legal)``: neighbouring rows of a conversation, at most
    ``block_rows``; ``legal`` counts the sound pairs of neighbouring roles within."""
    initial = F.left("role", F.lit(1))
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    first = F.when(F.col("blank") | F.col("seen"), "X").when(F.col("cut"), F.upper(role)).otherwise(role)
    symbols = F.concat(first, F.repeat(F.lit("X"), (F.col("n") - 1).cast("int")))
    part, place = F.shiftright("at", _POSITION_BITS), F.col("at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    packed = F.struct("at", symbols.alias("symbols"), role.alias("role"), "n")
    grouped = marked.groupBy("key", part.alias("_part"), F.floor(place / block_rows).alias("_block")).agg(
        F.sort_array(F.collect_list(packed)).alias("rows")
    )
    roles = F.col("rows.role")
    inside = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: _pairs(F.get(roles, i - 1), F.get(roles, i))), lambda x: x
    )
    return grouped.select(
        "key",
        F.get("rows", F.lit(0))["at"].alias("at"),
        F.array_join(F.col("rows.symbols"), "").alias("symbols"),
        F.get(roles, F.lit(0)).alias("first"),
        F.element_at(roles, -1).alias("last"),
        F.aggregate("rows.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
        F.size(inside).cast("long").alias("legal"),
    )


def audits(blocks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(key, illegal, cost, audit)`` of every conversation, from its blocks (stored or checkpointed)."""
    sequences = cut_lineage(blocks.groupBy("symbols").agg(F.count("*").alias("n")))
    made = cut_lineage(evaluated(sequences, grammar(sequences, rounds)))
    edges = F.col("edges")
    met = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.size(edges)), lambda i: _pairs(F.get(edges, i - 1)["last"], F.get(edges, i)["first"])
        ),
        lambda x: x,
    )
    whole = (
        blocks.groupBy("key")
        .agg(
            F.count("*").alias("n_blocks"),
            F.min_by("symbols", "at").alias("symbols"),
            F.sort_array(F.collect_list(F.struct("at", "first", "last"))).alias("edges"),
            F.sum("n").alias("n"),
            F.sum("legal").alias("legal"),
        )
        .select("key", "n_blocks", "symbols", (F.col("n") - 1 - F.col("legal") - F.size(met)).cast("long").alias("illegal"))
    )
    whole = cut_lineage(whole)
    alone = whole.filter("n_blocks = 1").join(made, "symbols").select(
        "key", "illegal", F.col("alone_cost").alias("cost"), F.col("alone_audit").alias("audit")
    )
    several = whole.filter("n_blocks > 1").select("key", "illegal")
    steps = (
        blocks.join(several.select("key"), "key", "left_semi")
        .join(made.select("symbols", "costs", "ranks"), "symbols")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("at", "costs", "ranks"))).alias("blocks"))
    )
    routes = cut_lineage(steps.mapInArrow(_routes, _ROUTES))
    pieces = (
        routes.select("key", F.explode(F.arrays_zip("ats", "entries")).alias("s"))
        .select("key", F.col("s.ats").alias("at"), F.col("s.entries").alias("entry"))
        .join(blocks.select("key", "at", "symbols"), ["key", "at"])
        .join(made.select("symbols", "audits"), "symbols")
        .select("key", "at", F.get("audits", F.col("entry")).alias("piece"))
    )
    joined = pieces.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "piece")))["piece"], "").alias("body"))
    longer = several.join(routes, "key").join(joined, "key").select(
        "key", "illegal", "cost", F.concat("body", F.repeat(F.lit("I"), F.col("tail"))).alias("audit")
    )
    return alone.unionByName(longer)


_ROUTES = "key string, cost long, tail int, ats array<long>, entries array<int>"


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        out = []
        for key, blocks in zip(batch["key"].to_pylist(), batch["blocks"].to_pylist()):
            cost, path, tail = walk([(b["costs"], b["ranks"]) for b in blocks])
            out.append((key, cost, tail, [b["at"] for b in blocks], [entry for _, entry in path]))
        columns = list(zip(*out)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _ROUTES.split(", ")]
        )


# --- repaired conversations -------------------------------------------------------------------

_TURNS = "key string, pos long, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each conversation led by its audit, to the repaired rows in order."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string()]
    key, audit, i, state, pos = None, "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal pos
            out.append((key, pos, role, text))
            pos += 1

        def inserts() -> None:
            nonlocal i, state
            while i < len(audit) and audit[i] == "I":
                role, state = _NEXT[state]
                put(role, "")
                i += 1

        columns = [batch[c].to_pylist() for c in ("key", "audit", "role", "text", "copies")]
        for row_key, row_audit, role, text, copies in zip(*columns):
            if row_audit is not None:
                inserts()  # those at the end of the conversation before
                key, audit, i, state, pos = row_key, row_audit, 0, 0, 0
                continue
            for _ in range(copies):
                inserts()
                letter, i = audit[i], i + 1
                if letter == "K":
                    state = _KEPT[state, role[0]]
                    put(role, text)
                elif letter == "R":
                    new, state = _NEXT[state]
                    put(new, text)
        yield _turn_batch(out, types)
    rest: list[tuple] = []
    while i < len(audit):
        role, state = _NEXT[state]
        rest.append((key, pos, role, ""))
        i, pos = i + 1, pos + 1
    if rest:
        yield _turn_batch(rest, types)


def _turn_batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _TURNS.split(", ")]
    )


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, pos, role, text)``: ``named`` rows edited as the audits say.

    The rows of a conversation lie together in one partition, in order of ``pos``.
    """
    lead = found.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("h"), F.lit("").alias("text"), F.lit(0).alias("copies"), "audit",
    )
    body = rows.select(
        "key", F.lit(1).alias("kind"), "turn", "role", _text_hash().alias("h"), "text", "copies",
        F.lit(None).cast("string").alias("audit"),
    )
    together = lead.unionByName(body).repartition("key").sortWithinPartitions("key", "kind", *_order())
    return together.mapInArrow(_edited, _TURNS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    schema = pa.schema([("key", pa.string()), ("digest", pa.string())])
    for batch in batches:
        done = []
        for row_key, role, text in zip(*(batch[c].to_pylist() for c in ("key", "role", "text"))):
            line = f"{role}:{text}".encode()
            if row_key == key:
                digest.update(b"\n" + line)
                continue
            if digest:
                done.append((key, digest.hexdigest()))
            key, digest = row_key, hashlib.sha256(line)
        yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "digest": [d for _, d in done]}, schema=schema)
    if digest:
        yield pa.RecordBatch.from_pydict({"key": [key], "digest": [digest.hexdigest()]}, schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """``(key, digest)``: SHA-256 of the ``role:text`` lines, from ``repaired_turns`` as they lie."""
    return turns.mapInArrow(_digested, "key string, digest string")


def repair(
    rows: DataFrame, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Report ``(key, gaps, blank, duplicate, truncated, illegal, cost, audit)`` and repaired turns of
    ``named`` rows; conversations without rows are in neither."""
    ship_package(rows.sparkSession)
    marked = cut_lineage(placed_rows(rows))
    found = cut_lineage(audits(cut_lineage(blocks_of(marked, block_rows)), rounds))
    return fault_counts(marked).join(found, "key"), repaired_turns(rows, found)


def report(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **more
) -> DataFrame:
    """Damage the conversations, repair them and report on every original id."""
    rows = named(turns, conv_id, turn, role, text)
    faults, fixed = repair(damaged(rows), **more)
    every = rows.select("key", "conv_id").distinct()
    whole = every.join(faults, "key", "left").join(digests(fixed), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
