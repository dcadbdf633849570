"""Repair of conversations: cheapest edits that give a well-formed sequence of roles, by dynamic programming over streams.

Rows go to partitions by conversation and are sorted there, so that a conversation of any length streams through one task
in Arrow batches. A first pass reads digests of the rows (no text) from the last turn to the first. It carries the costs of
repairing the rest from each of four states, and spills the best choice of every row and state as one byte, in pieces of
CHUNK rows. A second pass merges these pieces with the texts by the same order, from the first turn to the last, and follows
the choices. Neither pass holds more than a batch, a piece and the answer. Both sides of the merge go through Spark's
shuffle, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16
BLANKS = "\t\n\x0b\x0c\r "

#: Costs of the edits.
INSERT, RENAME, DELETE, OPEN_END = 3, 3, 4, 3
#: Letters of the edits in ASCII order; a choice is stored as its place here.
EDITS = "DIKR"

#: States: nothing yet, after a system row, a user row, an assistant row. What follows each by a new or renamed row:
EXPECTED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: What a kept row with initial s, u, a or another leads to; None where it may not stand.
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
INITIALS = "sua"
#: After the last row: cost from each state, and whether a row must be inserted.
END_COSTS, END_INSERTS = (0, 6, 3, 0), (False, True, True, False)

#: Faults of a row, and the figures of a conversation in order.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

KEYS = ("conv", "turn", "role", "mark")
#: ``kind`` orders rows of equal keys: pieces have 0, -1, ... from the last to the first, texts follow with 1.
PIECES = "conv string, turn long, role string, mark string, kind long, actions binary, figures array<long>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by the CRC-32 of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes its
    role user; the others stay. Null roles and texts become one space first, as null ids and turns do in the CRC's text.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"))
    rows = rows.where("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fault")


class Costs:
    """Steps of the programme, each worked out once: (costs from the four states, row) to (costs before the row, choices).

    Costs are kept less their least, so only a few different tuples ever occur.
    """

    def __init__(self):
        self.known = {}

    def before(self, costs: tuple, initial: int, fault: int) -> tuple[tuple, int, int]:
        """Costs in front of a row, less their least; the least; a byte with two bits for the choice in each state."""
        key = (costs, initial, fault)
        if key not in self.known:
            self.known[key] = self.step(*key)
        return self.known[key]

    @staticmethod
    def step(costs: tuple, initial: int, fault: int) -> tuple[tuple, int, int]:
        best = []
        for state in range(4):
            options = [(DELETE + costs[state], "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = OPEN_END if fault == TRUNCATED else 0
                if (to := KEEP[state][initial]) is not None:
                    options.append((extra + costs[to], "K"))
                options.append((RENAME + extra + costs[NEXT[state]], "R"))
            best.append(min(options))
        # An inserted row may come first: from 2 to 3 or back, and then from 0 or 1 to 2.
        best[2], best[3] = min(best[2], (INSERT + best[3][0], "I")), min(best[3], (INSERT + best[2][0], "I"))
        for state in (0, 1):
            best[state] = min(best[state], (INSERT + best[2][0], "I"))
        least = min(cost for cost, _ in best)
        return tuple(cost - least for cost, _ in best), least, sum(EDITS.index(letter) << 2 * state for state, (_, letter) in enumerate(best))


class Backward:
    """One conversation, read from its last row to its first."""

    def __init__(self, conv, costs: Costs):
        self.conv, self.table = conv, costs
        self.costs, self.total, self.actions = END_COSTS, 0, bytearray()
        self.counts, self.illegal, self.later = [0] * 4, 0, None
        self.first = self.last = None
        self.turns, self.pieces = 0, 0

    def add(self, key: tuple, known: bool, initial: int, fault: int):
        self.costs, least, choices = self.table.before(self.costs, initial, fault)
        self.total += least
        self.actions.append(choices)
        self.counts[fault] += 1
        if self.later is not None and (initial, self.later) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.later = initial
        if known and key[0] != self.first:
            self.first, self.last, self.turns = key[0], key[0] if self.last is None else self.last, self.turns + 1
        self.key = key if known else (None, *key[1:])

    def piece(self, whole: bool) -> tuple:
        """The choices since the last piece in the order of turns, under the key of their first row; the figures with the last."""
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        figures = [gaps, *self.counts[1:], self.illegal, self.total + self.costs[0]] if whole else None
        actions, self.actions = bytes(reversed(self.actions)), bytearray()
        self.pieces += 1
        return (self.conv, *self.key, 1 - self.pieces, actions, figures)


def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted digests of rows, last turn first, to pieces of choices."""
    costs, now = Costs(), None
    names = [f.split()[0] for f in PIECES.split(", ")]
    for batch in batches:
        out = []
        for conv, turn, role, mark, known, initial, fault in zip(*(batch[n].tolist() for n in (*KEYS, "known", "initial", "fault")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.piece(whole=True))
                now = Backward(conv, costs)
            elif len(now.actions) == CHUNK:
                out.append(now.piece(whole=False))
            now.add((turn, role, mark), known, initial, fault)
        yield frame(out, names)
    if now is not None:
        yield frame([now.piece(whole=True)], names)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Columns of plain objects: whole numbers beside nulls must not become floats."""
    return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(names, zip(*rows, strict=True) if rows else [[] for _ in names], strict=True)})


class Forward:
    """One conversation, read from its first row to its last, with the choices of the first pass."""

    def __init__(self, conv, sink):
        self.conv, self.sink = conv, sink
        self.state, self.pending, self.at, self.figures = 0, deque(), 0, [0] * len(FIGURES)

    def row(self, turn, role: str, text: str):
        while self.at == len(self.pending[0]):
            self.pending.popleft()
            self.at = 0
        choices = self.pending[0][self.at]
        self.at += 1
        while (letter := EDITS[choices >> 2 * self.state & 3]) == "I":
            self.insert()
        if letter == "R":
            role, self.state = EXPECTED[self.state], NEXT[self.state]
        elif letter == "K":
            self.state = KEEP[self.state][INITIALS.index(role[0])]
        self.sink.edit(letter, turn, role, text)

    def insert(self):
        role, self.state = EXPECTED[self.state], NEXT[self.state]
        self.sink.edit("I", None, role, "")

    def end(self):
        while END_INSERTS[self.state]:
            self.insert()
        return self.sink.end(self.conv, self.figures)


class Digest:
    """Audit and hash of one repaired conversation."""

    FIELDS = ", ".join(["conv string", *(f"{n} long" for n in FIGURES), "audit string", "repaired_sha256 string"])

    def __init__(self, conv, out: list):
        self.out, self.audit, self.hash, self.empty = out, bytearray(), hashlib.sha256(), True

    def edit(self, letter, turn, role, text):
        self.audit += letter.encode()
        if letter != "D":
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def end(self, conv, figures):
        self.out.append((conv, *figures, self.audit.decode(), self.hash.hexdigest()))


class Rows:
    """The rows of one conversation with their edits, deleted ones included; ``place`` counts the rows that are left."""

    FIELDS = "conv string, step long, edit string, place long, turn long, role string, text string"

    def __init__(self, conv, out: list):
        self.conv, self.out, self.step, self.place = conv, out, 0, 0

    def edit(self, letter, turn, role, text):
        self.out.append((self.conv, self.step, letter, None if letter == "D" else self.place, turn, role, text))
        self.step += 1
        self.place += letter != "D"

    def end(self, conv, figures):
        pass


def follow(batches: Iterator[pd.DataFrame], sink) -> Iterator[pd.DataFrame]:
    """Pieces of choices merged with texts, first turn first, to what ``sink`` makes of the edits."""
    names = [f.split()[0] for f in sink.FIELDS.split(", ")]
    now, out = None, []
    for batch in batches:
        for conv, turn, role, text, actions, figures in zip(*(batch[n].tolist() for n in ("conv", "at", "role", "text", "actions", "figures")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    now.end()
                now = Forward(conv, sink(conv, out))
            if actions is not None:
                now.pending.append(actions)
                now.figures = now.figures if figures is None else [int(x) for x in figures]
            elif text is not None:
                now.row(None if turn is None else int(turn), role, text)
        yield frame(out, names)
        out.clear()
    if now is not None:
        now.end()
        yield frame(out, names)


def faults(text: Column, earlier: Column) -> Column:
    """The first fault of a row that holds, as a number; ``earlier``: the same role and text stood before."""
    rest = F.rtrim(text, F.lit(BLANKS))
    return F.when(rest == "", BLANK).when(earlier, DUPLICATE).when(~F.right(rest, F.lit(1)).isin(*".!?"), TRUNCATED).otherwise(SOUND)


def keyed(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and ``mark``, a 128-bit digest of role and text; nulls of role and text are one space."""
    rows = rows.select(F.col("conv_id").cast("long").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
                       *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))
    return rows.withColumn("mark", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")))


def streamed(rows: DataFrame, known: DataFrame | None, sink) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(rows)
    # One shuffle by conversation serves the search for earlier copies and the sorted stream alike.
    digests = texts.select(*KEYS, faults(F.col("text"), F.lit(False)).cast("int").alias("fault")).repartition(n, "conv")
    nth = F.row_number().over(Window.partitionBy("conv", "role", "mark").orderBy(F.col("turn").asc_nulls_first()))
    again = (nth > 1) & (F.col("fault") != BLANK)
    initial = F.when(F.left("role", F.lit(1)) == "s", 0).when(F.left("role", F.lit(1)) == "u", 1).when(F.left("role", F.lit(1)) == "a", 2).otherwise(3)
    digests = digests.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault")))
    digests = digests.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), "role", "mark", F.col("turn").isNotNull().alias("known"), initial.alias("initial"), "fault")
    # Equal rows differ by their fault only: the first of them is no duplicate, so it comes last here.
    digests = digests.sortWithinPartitions("conv", F.col("known").desc(), *(F.col(c).desc() for c in ("turn", "role", "mark")), (F.col("fault") == DUPLICATE).desc())
    pieces = digests.mapInPandas(choose, PIECES)
    parts = pieces.withColumn("text", F.lit(None).cast("string")).unionByName(texts.withColumn("kind", F.lit(1).cast("long")), allowMissingColumns=True)
    if known is not None:
        parts = parts.unionByName(known.select(F.col("conv_id").cast("long").cast("string").alias("conv")).distinct(), allowMissingColumns=True)
    order = ["conv", *(F.col(c).asc_nulls_first() for c in ("turn", "role", "mark", "kind"))]
    parts = parts.repartition(n, "conv").sortWithinPartitions(*order)
    # Turns go to pandas as text, where a null does not turn whole numbers into floats.
    parts = parts.select("conv", F.col("turn").cast("string").alias("at"), "role", "text", "actions", "figures")

    def run(batches):
        return follow(batches, sink)

    out = parts.mapInPandas(run, sink.FIELDS)
    return out.select(F.col("conv").cast("long").alias("conv_id"), *out.columns[1:])


def audited(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``rows``: conv_id, faults counted, cost, audit (letters of the edits in order), repaired_sha256.

    ``rows`` has conv_id, turn, role and text; other columns are ignored. A conversation is read by turn, nulls first, and at
    equal turns by role and a digest of the text. Faults of a row: blank text, the same role and text earlier in the
    conversation, a last character other than full stop, exclamation or question mark; the first that holds counts. Edits are
    K(eep), R (new role, user or assistant), D(elete, a must for blank and repeated rows) and I(nsert a row with an empty
    text); an unfinished text that stays costs extra. Among the cheapest edits that leave no row, or an optional system row
    followed by pairs of user and assistant, those least in ASCII order are taken. Roles count by their first character;
    a role that is empty or of another initial cannot be kept. Null conversation ids make one conversation; null roles and texts are one space.
    ``known`` names conversations (conv_id) that get a row even if ``rows`` has none of theirs: zeros, no edits, the hash of
    the empty text. Empty tables give no rows.
    """
    return streamed(rows, known, Digest)


def repaired(rows: DataFrame) -> DataFrame:
    """The edits themselves, as ``audited`` counts them: conv_id, step, edit, place (null if deleted), turn, role, text.

    Rows with a place, in order of ``place``, are the repaired conversation; inserted ones have no turn.
    """
    return streamed(rows, None, Rows)


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS part
  FROM (SELECT unnest(range(256)) AS i)),
source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda v, b: xor(v >> 8, part[(xor(v, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, crc),
broken AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM source, (VALUES (0), (1)) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (
  SELECT *, md5(length(role) || ':' || role || ':' || text) AS mark, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS rest FROM broken),
counted_copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, mark ORDER BY turn NULLS FIRST) AS nth FROM placed),
numbered AS (
  SELECT conv_id, turn, role, text, CASE WHEN rest = '' THEN 1 WHEN nth > 1 THEN 2
      WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    left(role, 1) AS initial, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(left(role, 1)) OVER w AS before
  FROM counted_copies WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark, nth)),
-- A code is four times the cost plus the place of its letter in DIKR, so the least code is the cheapest edit, ties by letter.
back AS (
  SELECT DISTINCT conv_id, n + 1 AS i, 0::BIGINT AS e0, 25::BIGINT AS e1, 13::BIGINT AS e2, 0::BIGINT AS e3 FROM numbered
  UNION ALL
  SELECT conv_id, i, least(b0, (3 + (n2 >> 2)) * 4 + 1), least(b1, (3 + (n2 >> 2)) * 4 + 1), n2, n3 FROM (
    SELECT *, least(b2, (3 + (b3 >> 2)) * 4 + 1) AS n2, least(b3, (3 + (b2 >> 2)) * 4 + 1) AS n3 FROM (
      SELECT r.conv_id, r.i,
        least((4 + (e0 >> 2)) * 4, IF(stays AND initial = 's', (t + (e1 >> 2)) * 4 + 2, NULL), IF(stays AND initial = 'u', (t + (e2 >> 2)) * 4 + 2, NULL),
          IF(stays, (3 + t + (e2 >> 2)) * 4 + 3, NULL)) AS b0,
        least((4 + (e1 >> 2)) * 4, IF(stays AND initial = 'u', (t + (e2 >> 2)) * 4 + 2, NULL), IF(stays, (3 + t + (e2 >> 2)) * 4 + 3, NULL)) AS b1,
        least((4 + (e2 >> 2)) * 4, IF(stays AND initial = 'a', (t + (e3 >> 2)) * 4 + 2, NULL), IF(stays, (3 + t + (e3 >> 2)) * 4 + 3, NULL)) AS b2,
        least((4 + (e3 >> 2)) * 4, IF(stays AND initial = 'u', (t + (e2 >> 2)) * 4 + 2, NULL), IF(stays, (3 + t + (e2 >> 2)) * 4 + 3, NULL)) AS b3
      FROM back b JOIN (SELECT *, fault NOT IN (1, 2) AS stays, IF(fault = 3, 3, 0) AS t FROM numbered) r
        ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1))),
codes AS MATERIALIZED (
  SELECT b.conv_id, b.i, [e0, e1, e2, e3] AS code, r.role, r.text, r.initial FROM back b
  LEFT JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
walk AS (
  SELECT conv_id, i, 0 AS state, '' AS audit, '' AS repaired, initial IS NULL AS done FROM codes WHERE i = 1
  UNION ALL
  SELECT conv_id, i + IF(letter = 'I', 0, 1),
    CASE WHEN letter = 'D' THEN state WHEN letter = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END, audit || letter,
    repaired || CASE letter WHEN 'D' THEN '' ELSE IF(repaired = '', '', chr(10)) || CASE letter WHEN 'K' THEN role ELSE IF(state = 2, 'assistant', 'user') END
      || ':' || IF(letter = 'I', '', text) END, false
  FROM (SELECT w.*, c.role, c.text, c.initial, 'DIKR'[(c.code[w.state + 1] & 3) + 1] AS letter FROM walk w
    JOIN codes c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i WHERE c.initial IS NOT NULL OR w.state IN (1, 2))),
answers AS (
  SELECT w.conv_id, w.audit, w.repaired, c.code[1] >> 2 AS cost FROM walk w
  JOIN (SELECT conv_id, max(n) AS n FROM numbered GROUP BY conv_id) s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n + 1 AND w.state IN (0, 3)
  JOIN codes c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM numbered GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM k.conv_id
"""
