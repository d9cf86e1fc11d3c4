"""Conversation structure repair by a parallel Viterbi search whose chunks converge in rank.

A conversation's roles shall read ``(s?(ua)+)?`` by their initials. Its rows, in order of turn (NULL
first), then role, then the digest of the text, are kept, given another role, deleted, or joined by
inserted empty rows, at the least cost; see ``Costs``. Four states say what may follow: nothing yet, a
system row, a user row, an assistant row. Costs to go are vectors over these states, computed
backwards.

Rows are sorted once by range partitioning, so that a long conversation spreads over many tasks, and
are cut into chunks of one byte a row. Chunks run side by side: the last one of a conversation starts
from the true costs of the end, the others from a speculative vector. A fix-up pass reruns the chunks
whose starting vector differs from the one that their successor has found by more than a constant,
and stops within a chunk as soon as the new vector differs from the former one by a constant only;
passes go on until none differs. The stitched costs then drive the trace: each chunk states where it
leads from each state, these maps are chained, and the edits are read off forwards, always the
ASCII-least of the cheapest. Since every prefix of an audit fixes the state, this gives the least
audit.

Defined results: NULL roles and texts count as one blank. Rows without a fault are kept as they are
where that costs least. A row whose role and text occurred earlier in its conversation is a duplicate
(texts are compared by their MD5), rows that repeat a turn included. A conversation with a NULL id is
one conversation. Roles other than s..., u..., a... can only be deleted or replaced. An empty table gives
empty results, and other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import BLANKS, small_batches, stored

KEEP, REROLE, DELETE, INSERT = "KRDI"
ROLES = {"u": "user", "a": "assistant"}
_CHUNK = 4096
_ROW_BITS = 33          # of monotonically_increasing_id: place within the partition
_INITIALS = "sua"       # code of a row: initial (3 for others) + 4 * fault
_FINE, _MUST_GO, _CUT_OFF = 0, 1, 2
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FOLLOWS = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER,
            (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_INSERTED = {_START: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}

Vector = tuple[int, int, int, int]
_GUESS: Vector = (0, 0, 0, 0)


@dataclass(frozen=True)
class Costs:
    """Of a new role, a deletion, an inserted row, and a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Step:
    """What happens from a state up to and with a row: edits, inserted initials, the row's own new
    initial (empty if deleted), the state after it and the cost."""

    edits: str
    before: str
    initial: str
    state: int
    cost: int


class Search:
    """Costs to go and cheapest edits, remembered by vector: there are few once constants are off."""

    def __init__(self, costs: Costs):
        self.costs = costs
        big = 1 << 40
        self.end = self._inserting([0, big, big, 0])
        self._backward: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self._forward: dict[tuple[Vector, int, int], Step] = {}

    def _inserting(self, v: list[int]) -> Vector:
        """The vector if rows may be inserted first, as many as help."""
        v, price = list(v), self.costs.insert
        user, assistant = v[_USER], v[_ASSISTANT]
        v[_USER], v[_ASSISTANT] = min(user, price + assistant), min(assistant, price + user)
        for s in (_START, _SYSTEM):
            v[s] = min(v[s], price + v[_USER])
        return tuple(v)

    def _choices(self, code: int, state: int) -> list[tuple[str, str, int, int]]:
        """(edit, new initial, next state, cost) that a row admits."""
        initial, fault = _INITIALS[code % 4:][:1] if code % 4 < 3 else "", code // 4
        found = [(DELETE, "", state, self.costs.delete)]
        if fault != _MUST_GO:
            extra = self.costs.truncated if fault == _CUT_OFF else 0
            if (state, initial) in _FOLLOWS:
                found.append((KEEP, initial, _FOLLOWS[state, initial], extra))
            found += [(REROLE, r, _FOLLOWS[state, r], extra + self.costs.rerole)
                      for r in ROLES if (state, r) in _FOLLOWS]
        return found

    def raw_before(self, after: Vector, code: int) -> Vector:
        return self._inserting([min(cost + after[to] for _, _, to, cost in self._choices(code, s))
                                for s in range(4)])

    def before(self, after: Vector, code: int) -> Vector:
        """Costs to go before a row, without their constant."""
        known = self._backward.get((after, code))
        if known is None:
            raw = self.raw_before(after, code)
            known = self._backward[after, code] = tuple(x - min(raw) for x in raw)
        return known

    def step(self, after: Vector, code: int, state: int) -> Step:
        """The least cheapest edits from ``state`` before a row to the state after it."""
        known = self._forward.get((after, code, state))
        if known is None:
            togo = self.raw_before(after, code)
            edits, inserted, now, spent = "", "", state, 0
            while True:
                options = [(edit, initial, to, cost) for edit, initial, to, cost
                           in self._choices(code, now) if cost + after[to] == togo[now]]
                role = _INSERTED[now]
                to = _FOLLOWS[now, role]
                if self.costs.insert + togo[to] == togo[now]:
                    options.append((INSERT, role, to, self.costs.insert))
                edit, initial, to, cost = min(options)
                edits, spent, now = edits + edit, spent + cost, to
                if edit != INSERT:
                    break
                inserted += initial
            known = self._forward[after, code, state] = Step(edits, inserted, initial, now, spent)
        return known

    def tail(self, state: int) -> str:
        """Initials inserted at the end of a conversation."""
        return {_START: "", _SYSTEM: "ua", _USER: "a", _ASSISTANT: ""}[state]

    def vectors(self, codes: list[int], right: Vector) -> list[Vector]:
        """Costs to go after each row of a chunk, the one before its first row first."""
        found = [right]
        for code in reversed(codes):
            found.append(self.before(found[-1], code))
        return found[::-1]

    def fixed_up(self, codes: list[int], old_right: Vector, old_left: Vector, right: Vector) -> Vector:
        """The vector before the first row, given what it was for another start."""
        old, new = old_right, right
        for code in reversed(codes):
            if old == new:
                return old_left
            old, new = self.before(old, code), self.before(new, code)
        return new


@functools.cache
def _search(costs: Costs) -> Search:
    return Search(costs)


def _text(v: Vector) -> str:
    return ",".join(map(str, v))


def _vector(text: str) -> Vector:
    return tuple(map(int, text.split(",")))


def _codes(text: str) -> list[int]:
    return [ord(c) - 65 for c in text]


def marked(rows: DataFrame) -> DataFrame:
    """Stored rows (pos, conv_id, turn, role, text, initial, fault) in the order of the repair.

    ``rows`` has conv_id, turn, role and text. ``fault`` is blank, duplicate, truncated or NULL.
    """
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", "digest"]
    placed = stored(plain.withColumn("digest", F.md5(F.col("text").cast("binary")))
                    .repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("pos", F.monotonically_increasing_id()), "conversation-rows")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("_first"))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return placed.join(firsts.select("_first"), F.col("pos") == F.col("_first"), "left").select(
        "pos", "conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", "blank").when(F.col("_first").isNull(), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated").alias("fault"))


def _code(initial: str, fault: str) -> Column:
    kind = F.lit(3)
    for i, letter in enumerate(_INITIALS):
        kind = F.when(F.col(initial) == letter, i).otherwise(kind)
    wrong = F.when(F.col(fault).isin("blank", "duplicate"), _MUST_GO).when(
        F.col(fault).isNotNull(), _CUT_OFF).otherwise(_FINE)
    return F.char(kind + 4 * wrong + 65)


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Stored rows (conv_id, first_pos, codes, seq, last): up to ``size`` rows of one conversation."""
    place = F.col("pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    block = F.struct(F.shiftright("pos", _ROW_BITS).alias("p"), F.floor(place / size).alias("b"))
    packed = rows.select("conv_id", "pos", block.alias("block"), _code("initial", "fault").alias("c")) \
        .groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("r")) \
        .select("conv_id", F.col("r")[0]["pos"].alias("first_pos"),
                F.array_join(F.col("r.c"), "").alias("codes"))
    # A window over a conversation's chunks, of which there is one for thousands of its rows.
    along = Window.partitionBy("conv_id").orderBy("first_pos")
    return stored(packed.select(
        "conv_id", "first_pos", "codes", F.row_number().over(along).alias("seq"),
        F.lead("first_pos").over(along).isNull().alias("last")), "chunks")


def _mapped(df: DataFrame, schema: str, names: list[str], kinds: list[pa.DataType], row) -> DataFrame:
    """``row`` of each row's values gives the values of ``names``, put behind the columns of ``df``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [row(*values) for values in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                [*b.schema.names, *names])
    own = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(read, f"{own}, {schema}")


def _speculated(chunks: DataFrame, costs: Costs) -> DataFrame:
    """The chunks with ``start``, the vector behind their last row, and ``left``, before their first."""
    def run(_conv, _pos, codes, _seq, last):
        search = _search(costs)
        start = search.end if last else _GUESS
        return _text(start), _text(search.vectors(_codes(codes), start)[0])
    return stored(_mapped(chunks, "start string, left string", ["start", "left"],
                          [pa.string()] * 2, run), "speculated")


def _converged(chunks: DataFrame, costs: Costs) -> DataFrame:
    """The chunks with the true ``start``, but for a constant, after as many fix-up passes as needed."""
    def rerun(_conv, _pos, codes, _seq, _last, start, left, found):
        if found is None or found == start:
            return start, left, False
        again = _search(costs).fixed_up(_codes(codes), _vector(start), _vector(left), _vector(found))
        return found, _text(again), True

    columns = ["conv_id", "first_pos", "codes", "seq", "last", "start", "left"]
    runs = _speculated(chunks, costs)
    alone = runs.filter((F.col("seq") == 1) & F.col("last"))
    runs = runs.filter((F.col("seq") > 1) | ~F.col("last"))
    while True:
        after = runs.select(F.col("conv_id").alias("_c"), (F.col("seq") - 1).alias("_s"),
                            F.col("left").alias("found"))
        given = runs.join(after, F.col("conv_id").eqNullSafe(F.col("_c"))
                          & (F.col("seq") == F.col("_s")), "left").select(*columns, "found")
        again = stored(_mapped(
            given, "start2 string, left2 string, again boolean", ["start2", "left2", "again"],
            [pa.string(), pa.string(), pa.bool_()], rerun), "fixed-up")
        runs = again.select(*columns[:-2], F.col("start2").alias("start"), F.col("left2").alias("left"))
        if not again.filter("again").head(1):
            return alone.unionByName(runs)


def _entered(runs: DataFrame, costs: Costs) -> DataFrame:
    """The chunks with ``entry``, the state in which the trace comes to them."""
    def leads(_conv, _pos, codes, _seq, _last, start, _left):
        search, after = _search(costs), None
        codes = _codes(codes)
        after = search.vectors(codes, _vector(start))[1:]
        ends = list(range(4))
        for code, v in zip(codes, after, strict=True):
            ends = [search.step(v, code, s).state for s in ends]
        return (ends,)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        state, entries = _START, []
        for ends in table["ends"].to_pylist():
            entries.append(state)
            state = ends[state]
        return table.drop_columns(["ends"]).append_column("entry", pa.array(entries, pa.int32()))

    several = runs.filter((F.col("seq") > 1) | ~F.col("last"))
    maps = _mapped(several, "ends array<int>", ["ends"], [pa.list_(pa.int32())], leads).select(
        "conv_id", "seq", "ends")
    kind = dict(runs.dtypes)["conv_id"]
    entries = maps.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, seq int, entry int")
    entries = entries.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), "entry")
    return runs.join(entries, F.col("conv_id").eqNullSafe(F.col("_c")) & (
        F.col("seq") == F.col("_s")), "left").select(
        "conv_id", "first_pos", "codes", "seq", "last", "start", F.coalesce("entry", F.lit(0)).alias("entry"))


def traced(rows: DataFrame, costs: Costs = Costs(), chunk: int = _CHUNK) -> DataFrame:
    """Stored rows (conv_id, seq, first_pos, codes, audit, cost, steps, tail), one a chunk of ``marked`` rows.

    ``steps`` has for each row the initials inserted before it and its own (empty: deleted);
    ``tail`` those inserted behind the conversation's last row.
    """
    def trace(_conv, _pos, codes, _seq, last, start, state):
        search, codes = _search(costs), _codes(codes)
        after = search.vectors(codes, _vector(start))[1:]
        audit, cost, steps = [], 0, []
        for code, v in zip(codes, after, strict=True):
            step = search.step(v, code, state)
            state = step.state
            audit.append(step.edits)
            cost += step.cost
            steps.append({"before": step.before, "initial": step.initial})
        tail = search.tail(state) if last else ""
        return "".join(audit) + INSERT * len(tail), cost + len(tail) * costs.insert, steps, tail

    step = pa.struct([("before", pa.string()), ("initial", pa.string())])
    found = _mapped(
        _entered(_converged(_chunks(rows, chunk), costs), costs),
        "audit string, cost long, steps array<struct<before: string, initial: string>>, tail string",
        ["audit", "cost", "steps", "tail"], [pa.string(), pa.int64(), pa.list_(step), pa.string()], trace)
    return stored(found, "traced")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, of ``marked`` rows and their trace: (conv_id, pos, sub, role, text).

    Sorted by pos and sub they are in order.
    """
    size = F.size("steps")
    edits = found.select("first_pos", "tail", size.alias("n"), F.posexplode("steps").alias("i", "step")) \
        .select((F.col("first_pos") + F.col("i")).alias("_pos"), F.col("step.before").alias("before"),
                F.col("step.initial").alias("new"),
                F.when(F.col("i") == F.col("n") - 1, F.col("tail")).otherwise("").alias("behind"))

    def added(initials: Column) -> Column:
        letters = F.filter(F.split(initials, ""), lambda c: c != "")
        return F.transform(letters, lambda c: F.struct(
            F.when(c == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("new") == F.col("initial"), F.col("role")).when(
        F.col("new") == "u", ROLES["u"]).otherwise(ROLES["a"])
    own = F.when(F.col("new") == "", F.array().cast("array<struct<role: string, text: string>>")).otherwise(
        F.array(F.struct(role.alias("role"), F.col("text"))))
    lines = F.concat(added(F.col("before")), own, added(F.col("behind")))
    return rows.join(edits, F.col("pos") == F.col("_pos")).select(
        "conv_id", "pos", F.posexplode(lines).alias("sub", "line")).select(
        "conv_id", "pos", "sub", "line.role", "line.text")


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` of ``repaired``, joined by line breaks.

    A digest has to see a conversation's text in order, so one task streams it, a batch at a time.
    """
    kind = dict(lines.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out_type = None, None, None
        for b in batches:
            done, out_type = [], b.schema.field(0).type
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield _pairs(done, out_type)
        if digest is not None:
            yield _pairs([(now, digest.hexdigest())], out_type)

    def _pairs(done: list, out_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in done], out_type), pa.array([d[1] for d in done], pa.string())],
            ["conv_id", "repaired_sha256"])

    return (small_batches(lines).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")
            .select("conv_id", F.concat_ws(":", "role", "text"))
            .mapInArrow(read, f"conv_id {kind}, repaired_sha256 string"))


def measures(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost (long), and the audit."""
    turns = rows.groupBy("conv_id", "turn").agg(*[
        F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    faults = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # Initials of a chunk, with the last one of the chunk before it; a letter follows its code's rest by 4.
    initials = F.translate("codes", "ABCDEFGHIJKL", "suaxsuaxsuax")
    along = Window.partitionBy("conv_id").orderBy("seq")
    joined = found.withColumn("line", F.concat(
        F.coalesce(F.lag(F.right(initials, F.lit(1))).over(along), F.lit("")), initials))
    spots = F.sequence(F.lit(1), F.greatest(F.length("line") - 1, F.lit(1)))
    wrong = F.filter(spots, lambda i: ~F.col("line").substr(i, F.lit(2)).isin("su", "ua", "au")
                     & (F.length("line") > 1))
    edits = joined.groupBy("conv_id").agg(
        F.sum(F.size(wrong)).cast("long").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("seq", "audit")))["audit"], "").alias("audit"))
    return faults.join(edits.withColumnRenamed("conv_id", "_c"),
                       F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def repair_report(rows: DataFrame, every: DataFrame | None = None, costs: Costs = Costs(),
                  chunk: int = _CHUNK) -> DataFrame:
    """One row a conversation: ``measures`` and the digest of what the repair makes of it.

    Conversations of ``every`` (conv_id) without rows have zeros, an empty audit and the digest of
    nothing.
    """
    rows = stored(marked(rows), "marked")
    found = traced(rows, costs, chunk)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = measures(rows, found).join(
        digests(repaired(rows, found)).withColumnRenamed("conv_id", "_c"),
        F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    if every is not None:
        names = every.select(F.col("conv_id").alias("_e")).distinct()
        report = names.join(report, F.col("conv_id").eqNullSafe(F.col("_e")), "left").drop(
            "conv_id").withColumnRenamed("_e", "conv_id")
    return report.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after faults drawn by the CRC-32 of ``conv_id:turn``, mod 20.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                draw.alias("draw")).filter("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(
        F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.struct(
        "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text")), F.when(F.col("draw") == 3, 2).otherwise(1))
    return rows.select("conv_id", F.inline(copies))
