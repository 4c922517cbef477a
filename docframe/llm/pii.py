"""Personal data: fixed patterns, and terms that reveal a protected entity.

Everything here is DataFrame expressions. The patterns find e-mail and IP
addresses, card and phone numbers. Each distinct value found is a protected
entity. Corpus counts then estimate, for each term that stands near an entity,
how strongly the term reveals it: the share of the term's documents that name
the entity beside it, and the pointwise mutual information of the two. A term
beyond the thresholds is marked wherever it stands in the corpus; masking
generalises it, or removes it when it reveals the entity almost surely.

The share is judged by its lower confidence bound over distinct windows around the
entity, which reach across lines and wider than the terms that are weighed, so copies of one passage count once and make nothing revealing, and an
entity that is named twice can have revealing terms. What is protected is each
value and each kind of value: terms near values that are named once only are
weighed by all values of their kind.

The patterns are written so that no text makes them slow: a match may start only
at the head of a run of its first class, or where the last match ended, and
repetitions never give back what they took.

Places are running sums over what a pattern splits off, in pieces of bounded size,
so a text of very many matches costs about as much for each as one of few.

Defined results: null reads as empty and has no spans; spans are code points,
end exclusive; repeated rows are marked alike and count once in corpus counts by
id; a null id is an id; an empty table gives an empty table; a column called
``spans`` gives way to the new one, all other columns are kept. Terms may have any
length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.arrays import cut, let, running, text_pieces
from docframe.llm.common import Scratch, free_name, text_of

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in their order, each with its pattern and a test for texts that may hold it.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Words on each side of an entity that count as near it.
WINDOW = 10
#: Words on each side that tell copies of a passage from mentions of their own.
CONTEXT = 50
#: Standard deviations of the lower confidence bound on a share (one-sided, 90 %).
CONFIDENCE = 1.2816
#: Share of a term's documents that name the entity, and bits of mutual information, from which it reveals it.
DISCLOSURE, BITS = 0.5, 4.0
#: Share from which a term is removed rather than generalised.
REMOVAL = 0.9
#: Revealing candidates are broadcast up to this number, joined by shuffle beyond.
BROADCAST_TERMS = 50_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.coalesce(F.forall(F.split(value, r"\."), lambda p: p.try_cast("int") <= 255), F.lit(False))
    if kind == "card":
        n = F.char_length(_digits(value))
        return F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _placed(gaps: Column, sizes: Column, use: Callable[[Column, Column], Column]) -> Column:
    """Array of ``use(start, i)`` of each match, from the gap before it and its size."""
    steps = F.transform(sizes, lambda n, i: (F.get(gaps, i) + n).cast("bigint"))
    return let(running(steps), lambda at: F.transform(at, lambda x, i: let((x + F.get(gaps, i)).cast("int"), lambda start: use(start, i))))


def _spans_of(kind: str, text: Column) -> Column:
    """Valid spans of one kind: what the pattern splits off and what lies between adds up to the places."""
    number = KINDS.index(kind)
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    pieces = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def spans(p: Column) -> Column:
        def span(start: Column, i: Column) -> Column:
            value = F.get(p["values"], i)
            return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.char_length(value)).alias("end"), value.alias("value"))

        return F.filter(_placed(p["gaps"], F.transform(p["values"], lambda v: F.char_length(v)), span), lambda s: _valid(kind, s["value"]))

    return F.when(F.regexp_like(text, F.lit(HINTS[kind])), let(pieces, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All pattern spans of a text by start, then kind: start, kind number, end and value."""
    found = F.sort_array(F.concat(*[_spans_of(k, text) for k in PATTERNS]))
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), found).otherwise(F.array().cast(SPAN))


def _terms(text: Column) -> Column:
    """The terms of a text: its runs of letters in lower case, each once, in the order of their first place."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda t: t != "")


def _words(text: Column) -> Column:
    """A text cut before each run of letters: pieces of a word and what follows it; the first may hold no word."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}++\P{L}*+|\P{L}++"), F.lit(0))


def named_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row (a number), doc, text and base of the documents that name an entity; ``docs`` has doc, text, base."""
    # numbered first: Spark moves no filter below a number, so the spans are looked for once a row
    named = docs.withColumn("row", F.monotonically_increasing_id()).where(F.size("base") > 0)
    return scratch.keep(named.select("row", "doc", "text", "base"), "named")


def nearby_terms(named: DataFrame) -> DataFrame:
    """entity, kind, term, doc and window for each term within ``WINDOW`` words of an entity of the ``named_rows``.

    A word is a run of letters, so line ends, blanks and numbers use up nothing of the
    reach; words that the entity overlaps are its own. The window is a hash of
    ``CONTEXT`` words on each side with all that stands between them.
    """
    piece = named.select("row", F.posexplode(_words(F.col("text"))).alias("pos", "piece"))
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(so_far), F.lit(0)))
    word = F.regexp_extract("piece", r"^\p{L}*", 0)
    piece = piece.select("row", "at", F.lit(1).alias("turn"), "pos", (F.col("at") + F.char_length(word)).alias("stop"))

    # both sides of each entity among the starts of the words: a side comes before a word that starts at its place
    side = named.select("row", "doc", F.posexplode("base").alias("mention", "s"))
    side = side.select("row", "doc", "mention", F.col("s.value").alias("entity"), F.col("s.kind").alias("kind"), F.explode(F.array(F.struct(F.col("s.start").alias("at"), F.lit(True).alias("left")), F.struct(F.col("s.end").alias("at"), F.lit(False).alias("left")))).alias("x"))
    side = side.select("row", "doc", "mention", "entity", "kind", F.col("x.at").cast("long").alias("at"), "x.left", F.lit(0).alias("turn"))
    before = Window.partitionBy("row").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = piece.unionByName(side, allowMissingColumns=True)
    placed = placed.withColumn("last", F.coalesce(F.max("pos").over(before), F.lit(-1))).withColumn("last_stop", F.max("stop").over(before)).where("turn = 0")
    # the last word on the left ends before the entity, the first on the right starts behind it
    whole = F.col("last") - F.when(F.col("last_stop") > F.col("at"), 1).otherwise(0)
    reach = F.when(F.col("left"), F.transform(F.sequence(F.lit(0), F.lit(CONTEXT - 1)), lambda d: F.struct((whole - d).alias("pos"), (-1 - d).alias("step"))))
    reach = F.coalesce(reach, F.transform(F.sequence(F.lit(1), F.lit(CONTEXT)), lambda d: F.struct((F.col("last") + d).alias("pos"), d.alias("step"))))
    reach = placed.select("row", "mention", "doc", "entity", "kind", F.explode(reach).alias("x")).select("row", "mention", "doc", "entity", "kind", "x.*")

    text = named.select("row", F.posexplode(_words(F.col("text"))).alias("pos", "piece"))
    around = reach.join(text, ["row", "pos"]).groupBy("row", "mention", "doc", "entity", "kind")
    around = around.agg(F.sort_array(F.collect_list(F.struct("step", "piece"))).alias("around"))
    close = F.filter("around", lambda w: F.abs(w["step"]) <= WINDOW)
    terms = _terms(F.array_join(F.transform(close, lambda w: F.regexp_extract(w["piece"], r"^\p{L}*", 0)), " "))
    return around.select("entity", "kind", F.explode(terms).alias("term"), "doc", F.xxhash64("around").alias("window"))


def _bound(share: Column, mentions: Column) -> Column:
    """Wilson's lower bound of a share whose hits are ``mentions`` distinct ones."""
    n = mentions / share
    spread = CONFIDENCE * F.sqrt(share * (1 - share) / n + CONFIDENCE**2 / (4 * n * n))
    return (share + CONFIDENCE**2 / (2 * n) - spread) / (1 + CONFIDENCE**2 / n)


def _targets(named: DataFrame) -> DataFrame:
    """Each row once for its entity and once for the kind of it, as ``target``; no value equals the name of a kind."""
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return named.withColumn("target", F.explode(F.array("entity", kind))).drop("entity", "kind")


def revealing_terms(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, term and disclosure (the share for its strongest entity or kind) of every term beyond the thresholds, for each document that holds it.

    ``docs`` has doc (one key for all counts), text and base, the pattern spans.
    """
    named = named_rows(docs, scratch)
    near = scratch.keep(nearby_terms(named), "near")
    both = _targets(near)
    pairs = both.groupBy("target", "term").agg(F.count_distinct("window").alias("windows"), F.count_distinct("doc").alias("together"))
    # a term stands in at least the documents where it is near any entity: what cannot reach the share is out already
    reach = near.groupBy("term").agg(F.count_distinct("doc").alias("near_any"))
    pairs = pairs.join(reach, "term").where(_bound(F.col("together") / F.col("near_any"), F.col("windows")) >= DISCLOSURE)
    pairs = scratch.keep(pairs.drop("near_any"), "pairs")
    terms = pairs.select("term").distinct()
    bounded = terms.count() <= BROADCAST_TERMS
    # one pass over the words of the corpus: what stays is where the candidates stand
    words = docs.select("doc", F.explode(_terms(F.col("text"))).alias("term"))
    met = scratch.keep(words.join(F.broadcast(terms) if bounded else terms, "term", "left_semi"), "met")
    of_term = met.groupBy("term").agg(F.count_distinct("doc").alias("of_term"))
    share = F.col("together") / F.col("of_term")
    strong = pairs.join(of_term, "term").where(_bound(share, F.col("windows")) >= DISCLOSURE)
    found = named.select("doc", F.explode("base").alias("s")).select("doc", F.col("s.value").alias("entity"), F.col("s.kind").alias("kind"))
    of_target = _targets(found).groupBy("target").agg(F.count_distinct("doc").alias("of_target"))
    # all terms of a kind share its key, so the few kinds are broadcast
    is_kind = F.col("target").isin(*KINDS)
    joined = strong.where(~is_kind).join(of_target.where(~is_kind), "target").unionByName(strong.where(is_kind).join(F.broadcast(of_target.where(is_kind)), "target"))
    bits = F.log2(F.lit(docs.select("doc").distinct().count()) * F.col("together") / (F.col("of_term") * F.col("of_target")))
    revealing = joined.where(bits >= BITS).groupBy("term").agg(F.max(share).alias("disclosure"))
    return met.join(F.broadcast(revealing) if bounded else revealing, "term")


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of each revealing term in a text; letters of any case, whole words."""

    def spans(t: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})\Q"), t["term"], F.lit(r"\E(?!\p{L})"))
        size = F.char_length(t["term"])
        name = F.when(t["disclosure"] >= REMOVAL, "remove").otherwise("generalise")

        def span(start: Column, i: Column) -> Column:
            return F.struct(start.alias("start"), F.lit(KINDS.index("term")).alias("kind"), (start + size).alias("end"), name.alias("value"))

        # the last gap ends the text and is followed by no match
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
        return let(gaps, lambda g: _placed(g, F.transform(F.slice(g, 1, F.size(g) - 1), lambda _: size), span))

    return F.flatten(F.transform(terms, spans))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``spans``: base spans and those of revealing terms, by start, then kind."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = text_of(text_column)
    # one key for all counts: rows of one id are one document, and no id is an id
    keyed = docs.select(F.struct(F.col(id_column).alias("doc_id")).alias("doc"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    hit, terms = free_name(docs, "__hit"), free_name(docs, "__terms")
    found = revealing_terms(keyed, scratch).groupBy(F.col("doc.doc_id").alias(hit)).agg(F.sort_array(F.collect_set(F.struct("term", "disclosure"))).alias(terms))
    found = scratch.keep(found, "hit")
    scratch.drop_all_but("hit")
    out = docs.drop("spans").join(found, F.col(id_column).eqNullSafe(F.col(hit)), "left")
    more = F.coalesce(_term_spans(text, F.col(terms)), F.array().cast(SPAN))
    return out.withColumn("spans", F.sort_array(F.concat(base_spans(text), more))).drop(hit, terms)


def spell(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_base(span: Column) -> Column:
    return span["kind"] < KINDS.index("term")


def count_kind(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number))


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with spans, sorted by start, masked; overlapping spans become one, named after the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    def bound(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"].cast("bigint")), F.greatest)
        last = F.array_max(F.transform(spans, lambda s: s["end"])).cast("bigint")
        return F.struct(spans.alias("spans"), text_pieces(text).alias("pieces"), reach.alias("reach"), last.alias("last"), F.char_length(text).cast("bigint").alias("size"))

    def mask(p: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            name = F.when(s["value"].eqNullSafe(F.lit("remove")) & ~is_base(s), "").otherwise(F.get(names, s["kind"]))
            before = F.get(p["reach"], i)
            return F.when(s["start"] >= before, F.concat(cut(p["pieces"], before, s["start"]), name)).otherwise("")

        return F.concat(F.array_join(F.transform(p["spans"], part), ""), cut(p["pieces"], p["last"], p["size"]))

    return F.when(F.size(spans) > 0, let(let(spans, bound), mask)).otherwise(text)


def mask_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span of its text masked; texts without spans, and null ones, stay as they are."""
    marked = find_pii(docs, id_column, text_column)
    return marked.withColumn(text_column, mask_spans(F.col(text_column), F.col("spans"))).drop("spans")
