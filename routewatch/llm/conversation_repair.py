"""Repair of conversations' structure: the cheapest edits, by bidirectional Dijkstra over the edit lattice.

A conversation's rows and four states of the wanted order of roles, ``(s?(ua)+)?``, span a lattice:
node (rows read, state). Keep, Rerole and Delete read a row, Insert adds a turn. One heap searches from
the start, one from the end; when they have met they go on until no cheaper or equally cheap crossing is
left. The cheapest paths then run from the start to the crossings on forward distances and from there
to the end on reverse ones; of them the walk takes the least letter at each step. The letters so far tell the node,
so that walk gives the least audit.

Rows are streamed in order, sorted by Spark. Only a small code of each row enters the lattice, in
segments of ``SEGMENT`` rows: of a segment the cheapest audits between its states at both ends are kept
and put together, so a task's memory for one conversation is a segment and its audits, whatever its length.
"""

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .recent import Recent
from .shared import written

#: Rows of a conversation that are searched at once; audits of short ones that each worker remembers.
SEGMENT, KEPT = 2048, 20_000
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only turn of user or assistant that may come next, and its role.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
#: Faults of a row, the first that holds; letters of roles as numbers, 3 for any other.
BLANK, DUPLICATE, CUT = 1, 2, 3
LETTERS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _kept(state, letter):
    """The state after a kept row, or None."""
    if letter == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if letter == NEXT[state] - 1 else None


def _forward(codes, node):
    """Edges from a node: letter, cost, node. A row's code is its fault times 4 and its letter."""
    at, state = node >> 2, node & 3
    yield "I", INSERT, at << 2 | NEXT[state]
    if at < len(codes):
        fault, letter = divmod(codes[at], 4)
        ahead = at + 1 << 2
        yield "D", DELETE, ahead | state
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            kept = _kept(state, letter)
            if kept is not None:
                yield "K", more, ahead | kept
            yield "R", REROLE + more, ahead | NEXT[state]


def _backward(codes, node):
    """Edges to a node: letter, cost, node they come from."""
    at, state = node >> 2, node & 3
    for before in BEFORE[state]:
        yield "I", INSERT, at << 2 | before
    if at:
        fault, letter = divmod(codes[at - 1], 4)
        back = at - 1 << 2
        yield "D", DELETE, back | state
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            for before in BEFORE[state]:
                if letter == state - 1:
                    yield "K", more, back | before
                yield "R", REROLE + more, back | before
            if state == SYSTEM and letter == 0:
                yield "K", more, back | START


class _Side:
    """One of the two searches: tentative and settled distances."""

    def __init__(self, codes, edges, starts):
        self.codes, self.edges = codes, edges
        self.known, self.settled, self.heap = dict.fromkeys(starts, 0), {}, [(0, s) for s in starts]

    def settle(self, other, best):
        """Settle the nearest node; returns the cost of the cheapest whole path seen so far."""
        cost, node = heappop(self.heap)
        if node in self.settled:
            return best
        self.settled[node] = cost
        if node in other.known:
            best = min(best, cost + other.known[node])
        for _, step, far in self.edges(self.codes, node):
            if cost + step < self.known.get(far, 1 << 60):
                self.known[far] = cost + step
                heappush(self.heap, (cost + step, far))
                if far in other.known:
                    best = min(best, cost + step + other.known[far])
        return best


def cheapest(codes: bytes, entry=START, exits=(START, ASSISTANT)) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from state ``entry`` to one of ``exits``; None if there are none."""
    front = _Side(codes, _forward, [entry])
    back = _Side(codes, _backward, [len(codes) << 2 | state for state in exits])
    best = front.settle(back, 1 << 60)
    for _ in exits:
        best = back.settle(front, best)
    while front.heap and back.heap and front.heap[0][0] + back.heap[0][0] <= best:
        best = front.settle(back, best) if front.heap[0][0] <= back.heap[0][0] else back.settle(front, best)
    if best == 1 << 60:
        return None
    return best, _least(codes, entry, front.settled, back.settled, best)


def _least(codes, entry, ahead, left, best):
    """The least audit of all paths of cost ``best``, from distances from the start (``ahead``) and to the end (``left``)."""
    crossing = lambda node, step, far: far in left and ahead[node] + step + left[far] == best
    whole = lambda node: node in left and node in ahead and ahead[node] + left[node] == best
    open_nodes = [n for n in ahead if whole(n) or any(crossing(n, step, far) for _, step, far in _forward(codes, n))]
    good = set(open_nodes)
    while open_nodes:
        node = open_nodes.pop()
        for _, step, before in _backward(codes, node):
            if before not in good and before in ahead and ahead[before] + step == ahead[node]:
                good.add(before)
                open_nodes.append(before)
    audit, node, met = [], entry, False
    while True:
        met = met or whole(node)
        if met and left[node] == 0 and node >> 2 == len(codes):
            return "".join(audit)
        options = []
        for letter, step, far in _forward(codes, node):
            tight = met and far in left and left[node] == step + left[far]
            if node in good and not tight:
                tight = far in good and ahead[node] + step == ahead[far] or crossing(node, step, far)
            if tight:
                options.append((letter, far))
        letter, far = min(options)
        met = met or node in good and far in left and ahead[node] + dict((x, s) for x, s, _ in _forward(codes, node))[letter] + left[far] == best
        audit.append(letter)
        node = far


_SHORT = Recent(KEPT, cheapest)


class Audits:
    """The cheapest audits of one conversation, its row codes given in order."""

    def __init__(self):
        self.codes, self.ends = bytearray(), None

    def add(self, code):
        self.codes.append(code)
        if len(self.codes) == SEGMENT:
            self._fold()

    def _fold(self):
        """Put the cheapest audits of the segment behind those of the segments before."""
        found, segment = {}, bytes(self.codes)
        for entry, (cost, audit) in (self.ends or {START: (0, "")}).items():
            for state in range(4):
                more = cheapest(segment, entry, (state,))
                if more is not None:
                    whole = (cost + more[0], audit + more[1])
                    found[state] = min(found.get(state, whole), whole)
        self.codes, self.ends = bytearray(), found

    def result(self):
        if self.ends is None:
            return _SHORT[bytes(self.codes)]
        if self.codes:
            self._fold()
        return min(self.ends[s] for s in (START, ASSISTANT) if s in self.ends)


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of every row (null role and text: one space) and a digest of the latter two."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(named, 256)))


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and code of every row; texts stay behind."""
    letter = F.substring("role", 1, 1)
    number = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    facts = rows.select("conv_id", "turn", "role", "digest", number.alias("letter"), blank.alias("blank"), whole.alias("whole"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("whole"), CUT).otherwise(0)
    return facts.withColumn("again", again).select("conv_id", "turn", "role", "digest", (fault * 4 + F.col("letter")).alias("code"))


#: Ascending, nulls first, as Spark sorts by default.
_ORDER = ["conv_id", "kind", "turn", "role", "digest"]


class _Judged:
    """Counts of one conversation while its rows go past."""

    def __init__(self, conv):
        self.conv, self.audits, self.before = conv, Audits(), None
        self.low = self.turn = None
        self.distinct = self.illegal = 0
        self.faults = [0] * 4

    def add(self, turn, code):
        fault, letter = divmod(code, 4)
        self.faults[fault] += 1
        self.illegal += self.before is not None and (self.before, letter) not in LEGAL
        self.before = letter
        if turn is not None and turn != self.turn:
            self.low, self.turn, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.audits.add(code)

    def row(self):
        cost, audit = self.audits.result()
        gaps = self.turn - self.low + 1 - self.distinct if self.distinct else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, cost, audit


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in AUDITS.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string()]


def _judge(parts):
    now = None
    for part in parts:
        out = []
        for conv, kind, turn, code in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "code"))):
            if now is None or conv != now.conv:
                out += [now.row()] if now else []
                now = _Judged(conv)
            if kind:
                now.add(turn, code)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], _NAMES)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), _TYPES)], _NAMES)


def audits(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows go by turn (nulls first); rows of one turn by role, then by the SHA-256 of role and text, so repeated
    rows are next to each other. ``conversations`` (conv_id) names conversations to report even if they have no
    rows in ``turns``: zeros and an empty audit. Null ids are one conversation. Roles and texts that are null
    count as one space; a role that does not begin with s, u or a fits nowhere. An empty table gives no rows.
    Other columns are not read.
    """
    codes = _codes(_rows(turns)).withColumn("kind", F.lit(1))
    named = (turns if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = codes.unionByName(named.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "kind", "turn", "code").mapInArrow(_judge, AUDITS)


EDITED = "conv_id long, edit string, turn long, role string, text string"
_EDITED = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _edit(parts):
    audit, at, state = "", 0, START

    def inserted(conv):
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, "I", None, ROLE[state], ""
            at, state = at + 1, NEXT[state]

    for part in parts:
        out = []
        for conv, kind, turn, role, text, found in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "audit"))):
            if not kind:
                audit, at, state = found, 0, START
                out += inserted(conv)
                continue
            edit, at = audit[at], at + 1
            if edit == "R":
                role = ROLE[state]
            if edit != "D":
                state = SYSTEM if role[:1] == "s" else NEXT[state]
            out.append((conv, edit, turn, role, text))
            out += inserted(conv)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_EDITED)], schema=_EDITED)


def edited(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its edit (K, R, D) and its new role, and the inserted ones (I), in order within each partition.

    ``found`` are the ``audits`` of the same rows. Every conversation lies in one partition.
    """
    rows = _rows(turns).withColumn("kind", F.lit(1)).unionByName(found.select("conv_id", "audit", F.lit(0).alias("kind")), allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return rows.select("conv_id", "kind", "turn", "role", "text", "audit").mapInArrow(_edit, EDITED)


def _digest(parts):
    """conv_id and SHA-256 of the role:text lines of each conversation's rows, as they go past."""
    now, sha, any_row = None, None, False

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

    for part in parts:
        out = []
        for conv, edit, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
            if sha is None or conv != now:
                out += [(now, sha.hexdigest())] if sha else []
                now, sha, any_row = conv, hashlib.sha256(), False
            if edit != "D":
                sha.update(f"{chr(10) if any_row else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                any_row = True
        yield batch(out)
    if sha:
        yield batch([(now, sha.hexdigest())])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of what ``edited`` gives, as it lies; conversations without any row have none."""
    return rows.mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The ``audits`` of all conversations and the SHA-256 of each repaired one (``repaired_sha256``)."""
    found = written(audits(turns, conversations), "audits")
    made = digests(edited(turns, found)).withColumnsRenamed({"conv_id": "own"})
    empty = hashlib.sha256().hexdigest()
    return found.join(made, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20, nulls written as one space."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    rows = rows.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("again", F.explode(times)).select("conv_id", "turn", "role", "text")
