"""Quality rules judged per host.

Every document is measured once. Rule failures are added up by host (the `source` column), and each host's failure
rates are shrunk towards the rate of all hosts by a beta prior whose strength is fitted to the spread between hosts (method of
moments). A host is bad under a rule if its shrunk rate is above `BAD_RATE`, or lies above that of all hosts by `BAD_SPREADS` standard deviations of the prior, and is
`BAD_TIMES` as high: where hosts differ by chance only, none is bad, and where they differ a host need not fail half of its documents. The verdict on a document joins both:
it goes if it fails a base rule, or if it fails some rule of its own and its host is bad under that rule. So a
bad host loses what breaks the rule it is known for, and a clean document stays wherever it comes from.

Null text has no words, and an empty text likewise. A null source is a host of its own. Repeated rows are measured one by one.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm.common import arrow_pass, documents, small
from wrenchlake.session import stage

#: A host is bad under a rule if its shrunk failure rate is above this, or above that of all hosts by so many deviations of the
#: prior and so many times as high.
BAD_RATE = 0.5
BAD_SPREADS = 1.0
BAD_TIMES = 2.0
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1000.0)

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

#: Rules by name, over the measures; a document fails where the condition holds. The first two are the base rules.
RULES = {
    "few_words": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE = ("few_words", "repetitive")


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered = end = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def _dup_lines(lines: list[bytes]) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in lines:
        if line.strip():
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return repeated


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    return (
        len(words),
        len(text or "") - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        sum(1 for x in lines if x.strip()),
        _dup_lines(lines),
        _repeat_words(words),
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in `keep`, then the measures of the text, then a boolean per rule."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], MEASURES])
    wanted = list(dict.fromkeys([*keep, text]))

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        got = [measures(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        out: dict[str, object] = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
        return out | {n: [g[i] for g in got] for i, n in enumerate(names)}

    measured = arrow_pass(docs.select(*wanted), rows, schema)
    return measured.withColumns({f"fails_{name}": F.expr(rule) for name, rule in RULES.items()})


def bad_hosts(measured: DataFrame) -> DataFrame:
    """(host, bad_<rule> ...) for the hosts that are bad under at least one rule."""
    hosts = stage(
        measured.groupBy(F.col("source").alias("host")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES]
        )
    )
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("docs"),
        F.sum(1 / F.col("n")).alias("inverse"),
        *[F.sum(r).alias(f"fails_{r}") for r in RULES],
        *[F.var_pop(F.col(r) / F.col("n")).alias(f"spread_{r}") for r in RULES],
    ).first()
    if not moments["hosts"]:
        return hosts.select("host", *[F.lit(False).alias(f"bad_{r}") for r in RULES])
    flags = {}
    for r in RULES:
        mean = moments[f"fails_{r}"] / moments["docs"]
        # What documents drawn at random would spread by themselves is no difference between hosts.
        between = moments[f"spread_{r}"] - mean * (1 - mean) * moments["inverse"] / moments["hosts"]
        strength = min(max(mean * (1 - mean) / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]
        limit = min(BAD_RATE, max(BAD_TIMES * mean, mean + BAD_SPREADS * math.sqrt(mean * (1 - mean) / (strength + 1))))
        flags[f"bad_{r}"] = (F.col(r) + mean * strength) / (F.col("n") + strength) > limit
    judged = hosts.select("host", *[c.alias(n) for n, c in flags.items()])
    return judged.filter(" or ".join(flags))


def judge(measured: DataFrame, bad: DataFrame, source: str = "source") -> DataFrame:
    """Add `base_failed` and `kept`. Bad hosts are broadcast if a count allows it, else joined in shares."""
    bad = stage(bad)
    left, match = measured, F.col(source).eqNullSafe(F.col("host"))
    if small(bad):
        right = F.broadcast(bad)
    else:
        # Any host may be hot: each bad host is written once per share, and its documents are dealt over them.
        right = bad.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(31))))
        left = left.withColumn("__share", F.pmod(F.xxhash64(*measured.columns), F.lit(32)).cast("int"))
        match = match & left["__share"].eqNullSafe(right["__share"])
    base: Column = F.lit(False)
    host: Column = F.lit(False)
    for r in RULES:
        if r in BASE:
            base = base | F.col(f"fails_{r}")
        host = host | (F.col(f"fails_{r}") & F.coalesce(F.col(f"bad_{r}"), F.lit(False)))
    joined = left.join(right, match, "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~host).select(
        *measured.columns, "base_failed", "kept"
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, the measures, the rules it fails, base_failed and kept."""
    measured = stage(measure(docs, ["doc_id", "source"]))
    return judge(measured, bad_hosts(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; the texts are measured again rather than shuffled."""
    bad = bad_hosts(stage(measure(docs, ["source"])))
    # Columns are numbered meanwhile, so none of theirs clashes with one of the measures.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    number = {c: n for n, c in names.items()}
    measured = measure(docs.toDF(*names), list(names), number["text"])
    kept = judge(measured, bad, number["source"]).filter("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    sums = ", ".join(f"sum(CAST({rule} AS INT)) AS {name}" for name, rule in RULES.items())
    prior = ", ".join(
        f"sum({r}) / sum(n) AS mean_{r}, var_pop({r} / n) - (sum({r}) / sum(n)) * (1 - sum({r}) / sum(n)) * sum(1 / n) / count(*) AS between_{r}"
        for r in RULES
    )
    strength = lambda r: f"CASE WHEN between_{r} > 0 THEN least(greatest(mean_{r} * (1 - mean_{r}) / between_{r} - 1, {STRENGTH[0]}), {STRENGTH[1]}) ELSE {STRENGTH[1]} END"
    limit = lambda r: f"least({BAD_RATE}::DOUBLE, greatest({BAD_TIMES}::DOUBLE * mean_{r}, mean_{r} + {BAD_SPREADS}::DOUBLE * sqrt(mean_{r} * (1 - mean_{r}) / ({strength(r)} + 1))))"
    bad = ", ".join(f"({r} + mean_{r} * ({strength(r)})) / (n + {strength(r)}) > {limit(r)} AS bad_{r}" for r in RULES)
    base = " OR ".join(f"({RULES[r]})" for r in BASE)
    host = " OR ".join(f"(({rule}) AND bad_{r})" for r, rule in RULES.items())
    return f"""
WITH rowed AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM rowed),
windows AS (SELECT row, i, [w[i], w[i + 1], w[i + 2]] AS t FROM words, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, t) AS n FROM windows),
covered AS (SELECT row, count(DISTINCT i + d) AS n FROM twice, unnest([0, 1, 2]) AS s(d) WHERE n > 1 GROUP BY row),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM rowed),
dup AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
m AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_lines, 0) AS n_lines,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM rowed JOIN words USING (row) LEFT JOIN covered USING (row) LEFT JOIN dup USING (row)),
hosts AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, {sums} FROM m GROUP BY source),
prior AS (SELECT {prior} FROM hosts),
bad AS (SELECT host, {bad} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
  NOT (({base}) OR {host}) AS kept
FROM m JOIN bad ON source IS NOT DISTINCT FROM host"""


SQL = _sql()
