"""Quality rules as a short-circuit cascade.

Each rule rejects a text on one measure. A sample of the input gives every
rule's cost (seconds) and selectivity (share rejected); rules run in the order of
rejection per cost, and a text leaves at the first rule that rejects it, so what
only later rules measure is never computed for it. The order changes the time
only, never the verdict.

Words are runs of characters other than ASCII white space. Defined results: null
reads as empty, which has no words and is rejected as too short; repeated rows
are judged alike; an empty table gives an empty table; a column of the input that
has the name of a new one gives way to it, others are kept.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import bounded_batches, frugal, text_of

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: ASCII bytes that are neither letters nor blanks.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalpha())
BULLETS, ELLIPSES = ("-", "*", "•", "‣", "·"), ("...", "…")
#: Rows of the sample that orders the rules, at most.
SAMPLE_ROWS = 256


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # splits bytes at ASCII white space alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, BLANKS)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        total, end = 0, 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def n_upper_words(self) -> int:
        return sum(w.isupper() for w in self.text.split())

    @cached_property
    def n_marks(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, MARKS))

    @cached_property
    def stripped_lines(self) -> list[str]:
        return [x for x in map(str.strip, self.text.split("\n")) if x]

    @cached_property
    def n_bullet_lines(self) -> int:
        return sum(x.startswith(BULLETS) for x in self.stripped_lines)

    @cached_property
    def n_cut_lines(self) -> int:
        return sum(x.endswith(ELLIPSES) for x in self.stripped_lines)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


RULES = (
    Rule("too_few_words", lambda m: m.n_words < 50),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("many_symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("mean_word_length", lambda m: not 3 * m.n_words <= m.word_chars <= 10 * m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("shouting", lambda m: 2 * m.n_upper_words > m.n_words),
    Rule("few_letters", lambda m: 2 * m.n_marks > m.word_chars),
    Rule("bullet_list", lambda m: 10 * m.n_bullet_lines > 9 * len(m.stripped_lines)),
    Rule("cut_lines", lambda m: 10 * m.n_cut_lines > 3 * len(m.stripped_lines) and m.n_cut_lines > 1),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """rule, cost (seconds a text) and selectivity of each rule on a sample of at most ``rows`` texts.

    The sample is those with the least hash of id and length; hashes alone choose
    it, so no more texts than these move, and one task measures them.
    """
    hashed = docs.select(text_of(text_column).alias("text"), F.xxhash64(F.col(id_column), F.length(text_column)).alias("h"))
    last = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    sample = hashed.where(F.col("h") <= F.lit(last).cast("long")).select("text").limit(rows)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for f in frames for t in f["text"]]
        out = []
        for r in rules:
            began = time.perf_counter()
            rejected = sum(r.rejects(Measures(t)) for t in texts)
            out.append((r.name, (time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts))))
        yield pd.DataFrame(out, columns=["rule", "cost", "selectivity"])

    return sample.coalesce(1).mapInPandas(measure, "rule string, cost double, selectivity double")


def cascade_order(profile: list, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejection per cost, most first; a rule without a profile comes last."""
    gain = {p["rule"]: p["selectivity"] / max(p["cost"], 1e-9) for p in profile}
    return tuple(sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name)))


def cascade(m: Measures, order: tuple[Rule, ...]) -> tuple[int, str | None]:
    """Number of rules that ran, and the name of the one that rejected the text, if any; no rule runs behind it."""
    for i, r in enumerate(order):
        if r.rejects(m):
            return i + 1, r.name
    return len(order), None


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text", measures: bool = False) -> DataFrame:
    """``docs`` with ``kept``; with ``measures`` also the counts of ``MEASURES``, ``rules_run`` and ``rejected_by``.

    These counts are then computed for every row, further ones only as far as the cascade asks for them.
    """
    bounded_batches(docs.sparkSession)
    order = cascade_order(rule_profile(docs, rules, id_column, text_column).collect(), rules)
    added = {m: "long" for m in MEASURES} | {"rules_run": "int", "rejected_by": "string"} if measures else {}
    added |= {"kept": "boolean"}
    others = [c for c in docs.columns if c not in added]
    hidden = "__text" + "_" * max(map(len, docs.columns))
    held = docs.select(*others, text_of(text_column).alias(hidden))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{n} {t}" for n, t in added.items()])

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, list] = {n: [] for n in added}
            for text in b.column(hidden):
                m = Measures(text.as_py())
                ran, by = cascade(m, order)
                found = {"rules_run": ran, "rejected_by": by, "kept": by is None}
                for n, values in made.items():
                    values.append(found[n] if n in found else getattr(m, n))
            columns = [b.column(c) for c in others] + [pa.array(v, arrow[added[n]]) for n, v in made.items()]
            yield pa.RecordBatch.from_arrays(columns, [*others, *added])

    return held.mapInArrow(frugal(run), schema)
