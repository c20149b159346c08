"""Secrets in texts, by one automaton for all rules.

One pass over the bytes of a text with the combined automaton tells which
rules match in it. Only for those a small automaton of the rule then measures
the matches: leftmost, longest, not overlapping within the rule. The automata
are built once in a Python worker.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Moves, combined, letters_in_either_case
from .common import as_bytes, bounded_batches


class Rule(NamedTuple):
    """A kind of secret: ``head`` once, then the byte class ``body`` one or
    more times, as regular expressions over bytes. A match counts if it has
    ``least`` bytes, or, if ``of_body``, if its body has. ``clue`` is a simpler
    expression that every match contains."""

    kind: str
    head: str
    body: str
    least: int
    of_body: bool = False
    clue: str = ""

    def pattern(self) -> str:
        return f"{self.head}{self.body}+"

    def sign(self) -> str:
        """What the pass over the bytes looks for: no more than tells that a
        match may be there, so that the rules' states multiply little."""
        if self.clue:
            return self.clue
        return self.head + self.body if self.head else f"{self.body}{{{self.least}}}"


# The first three are the base rules, the others follow the
# published formats of keys.
RULES = (
    Rule("assign", letters_in_either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 20),
    Rule("hex", "", "[0-9a-f]", 24),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 20),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 39),
    Rule("stripe", "[rs]k_live_", "[A-Za-z0-9]", 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 40, clue="eyJ[A-Za-z0-9_-]"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY----", "-", 27),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:long,end:long>>"
MARK = "[SECRET]"


class _Machines(NamedTuple):
    scan: Moves
    matches: list[Moves]
    heads: list[Moves]
    starts: list[set[int]]


@lru_cache(maxsize=4)
def machines(rules: tuple[Rule, ...]) -> _Machines:
    scan = combined([r.sign().encode() for r in rules])
    matches = [combined([r.pattern().encode()], anywhere=False) for r in rules]
    heads = [combined([r.head.encode()], anywhere=False) for r in rules]
    starts = [{b for b in range(256) if m.table[m.start + b] != m.dead} for m in matches]
    return _Machines(scan, matches, heads, starts)


def find(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, in order."""
    use = machines(rules)
    present, found = use.scan.rules_in(data), []
    for number, rule in enumerate(rules):
        if not present >> number & 1:
            continue
        match, starts, at = use.matches[number], use.starts[number], 0
        while at < len(data):
            end = match.longest(data, at) if data[at] in starts else -1
            if end < 0:
                at += 1
                continue
            body = use.heads[number].longest(data, at) if rule.of_body else at
            if end - body >= rule.least:
                found.append((at, number, end))
            at = end
    return sorted(found)


def _in_code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    places, before, count = {}, 0, 0
    for offset in sorted(offsets):
        count += len(data[before:offset].decode("utf-8", "replace"))
        places[offset], before = count, offset
    return places


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(doc_id, spans): every match of every rule, by start, then rule order.

    Offsets are code points, the end not included. A row per row of ``docs``;
    null and empty texts have no spans. Other columns are not read. An empty
    table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_py()
                found = find(data, rules)
                place = _in_code_points(data, [x for s, _, e in found for x in (s, e)])
                rows.append([{"kind": rules[k].kind, "start": place[s], "end": place[e]} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules=RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``MARK``; matches that overlap
    are replaced as one. ``length_col``, if there, gets the new length of the
    texts that changed. Null texts and all other columns stay as they are."""
    bounded_batches(docs.sparkSession)
    columns, schema = docs.columns, docs.schema

    def clean(data: bytes) -> bytes:
        kept, at = [], 0
        for start, _, end in find(data, rules):
            if start >= at:
                kept += [data[at:start], MARK.encode()]
            at = max(at, end)
        return b"".join([*kept, data[at:]])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            place = columns.index(text_col)
            old = [t.as_py() for t in batch.column(place).cast(pa.binary())]
            new = [t if t is None else clean(t) for t in old]
            arrays = list(batch.columns)
            arrays[place] = pa.array(new, pa.binary()).cast(pa.string())
            if length_col in columns:
                at = columns.index(length_col)
                changed = pa.array([a != b for a, b in zip(old, new)], pa.bool_())
                sizes = pc.utf8_length(arrays[place]).cast(arrays[at].type)
                arrays[at] = pc.if_else(changed, sizes, arrays[at])
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""
    found = scan(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(*BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """SQL for ``report``. The k-th match of a rule begins after the first k
    pieces between matches and the k - 1 matches before it."""
    parts = []
    for number, rule in enumerate(RULES):
        pattern = (f"(?:{rule.head}){rule.body}+").replace("'", "''")
        value = f"regexp_replace(m, '^(?:{rule.head.replace(chr(39), chr(39) * 2)})', '')" if rule.of_body else "m"
        parts.append(f"""
SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, s AS a, s + length(m) AS z FROM (
  SELECT doc_id, ms[i] AS m,
    coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps
        FROM texts), LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i))
WHERE length({value}) >= {rule.least}""")
    spans = " UNION ALL ".join(parts)
    text = "kind || ':' || a::BIGINT || ':' || z::BIGINT"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans})
SELECT d.doc_id,
  {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg({text}, ',' ORDER BY a, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY a, k) FILTER (kind IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
