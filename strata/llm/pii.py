"""Personal data by patterns, and terms that give it away by information theory. DataFrame functions only.

Protected entities are the values the patterns find. A term (a word of three letters or more) near an entity, that is in
its line, may disclose it even after the entity is gone. Everything is counted in distinct lines of the corpus, so copies
of lines or documents neither raise nor lower a count. With N of them, n(t) with term t, n(e) with entity e and n(t, e)
with both, the pointwise mutual information of t and e is log2(n(t, e) N / (n(t) n(e))), and the information of e is
-log2(n(e) / N). Their ratio is the share of e's information that t discloses: 1 if t occurs with e only. Anywhere in
a document that mentions e, or on demand in all documents, terms with a ratio of ``generalise_at`` or more are
generalised, of ``remove_at`` or more removed, if n(t, e) is ``support`` or more.

A null text is empty. Rows equal in id and text are one document and get the same result each; other columns are
not read. Spans are in code points, the end exclusive, by start, then by kind as in :data:`KINDS`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.text import SPANS, row_hash
from strata.session import run_dir

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")

# Patterns find what the plain ones below find, in linear time: a run is entered at its beginning or where the last
# match ended (\G), and quantifiers that need not give back are possessive. Runs too short to count are not matched.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its pattern is tried.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"\p{L}[\p{L}\p{N}]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def luhn(digits: Column) -> Column:
    def place(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + place(i))
    return total % 10 == 0


def _card(hit: Column) -> Column:
    return let(F.regexp_replace(hit, "[ -]", ""), lambda d: F.length(d).between(12, 19) & F.when(F.length(d) < 20, luhn(d)))


VALID = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"),
    "card": _card,
    "phone": lambda hit: F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15),
}


def running(lengths: Column) -> Column:
    """Running totals, from 0."""
    more = lambda totals, n: F.array_append(totals, F.element_at(totals, -1) + n)
    return F.aggregate(lengths, F.array(F.lit(0)), more)


def matches(text: Column, pattern: Column) -> Column:
    """(start, end, hit) of every match, from the lengths of the matches and of what lies between them."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    cut = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("between"))
    steps = lambda z: F.zip_with(
        z["hits"], F.slice(z["between"], F.lit(1), F.size(z["hits"])), lambda h, b: F.length(h) + F.length(b)
    )

    def place(z: Column) -> Column:
        def one(hit, i):
            return F.struct((z["ends"][i + 1] - F.length(hit)).alias("start"), z["ends"][i + 1].alias("end"), hit.alias("hit"))

        return F.transform(z["hits"], one)

    return let(cut, lambda z: let(F.struct(z["hits"].alias("hits"), running(steps(z)).alias("ends")), place))


SORTED = "array<struct<start: bigint, place: int, end: bigint, kind: string, hit: string>>"


def _spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: VALID[kind](m["hit"]))
    named = F.transform(
        found, lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)), m["end"], F.lit(kind), m["hit"])
    )
    return F.when(NEEDS[kind](text), named.cast(SORTED)).otherwise(F.array().cast(SORTED))


def base_spans(text: Column) -> Column:
    """Spans of all patterns: start, place of the kind, end, kind, hit; in this order."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in PATTERNS]))


def entity(kind: Column, hit: Column) -> Column:
    """An entity's name: the value without its formatting."""
    plain = F.when(kind.isin("card", "phone"), F.regexp_replace(hit, "[^0-9]", "")).otherwise(F.lower(hit))
    return F.concat_ws(":", kind, plain)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def mentions(found: DataFrame) -> DataFrame:
    """``_key``, ``entity``, ``line`` (its hash) and the line's ``terms`` around the span, per span."""
    spans = found.where(F.size("base") > 0).select("_key", "_text", F.explode("base").alias("s"))
    head = F.substring_index(F.substring(F.col("_text"), F.lit(1), F.col("s.start").cast("int")), "\n", -1)
    tail = F.substring(F.col("_text"), F.col("s.end").cast("int") + 1, F.length("_text"))
    tail = F.substring_index(tail, "\n", 1)
    spans = spans.select(
        "_key", entity(F.col("s.kind"), F.col("s.hit")).alias("entity"), head.alias("h"), F.col("s.hit").alias("hit"), tail.alias("t")
    )
    line = F.xxhash64(F.concat("h", "hit", "t")).alias("line")  # no span crosses the end of a line
    return spans.select("_key", "entity", line, _terms(F.concat_ws(" ", "h", "t")).alias("terms"))


def distinct_lines(texts: DataFrame) -> DataFrame:
    """``_text``: every line of the texts once."""
    return texts.select(F.explode(F.split("_text", "\n", -1)).alias("_text")).distinct()


def disclosing(near: DataFrame, texts: DataFrame, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """``entity``, ``term``, ``ratio``, ``action`` of the terms at or above the thresholds.

    ``near`` are mentions, ``texts`` what terms are counted in (column ``_text``): the corpus in the unit of ``near``, that is
    its distinct lines. Terms are counted by partial aggregation before they meet the few candidates.
    """
    lines = near.select("entity", "line").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    both = near.select("entity", "line", F.explode("terms").alias("term")).distinct()
    both = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    terms = texts.select(F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    everything = texts.agg(F.count(F.lit(1)).alias("n"))
    rated = both.join(lines, "entity").join(terms, "term").crossJoin(F.broadcast(everything))  # one row
    information = -F.log2(F.least(F.col("n_e") / F.col("n"), F.lit(1.0)))
    ratio = 1 + F.log2(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))) / information
    rated = rated.where(information > 0).select("entity", "term", ratio.alias("ratio"))
    action = F.when(F.col("ratio") >= remove_at, "remove").otherwise("generalise")
    return rated.where(F.col("ratio") >= generalise_at).withColumn("action", action)


def _term_spans(text: Column, base: Column, terms: Column, action: str) -> Column:
    """Whole words among ``terms``, outside the base spans. Terms consist of letters and digits only."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    apart = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    found = F.transform(
        F.filter(matches(text, pattern), apart),
        lambda m: F.struct(m["start"], F.lit(KINDS.index(action)), m["end"], F.lit(action), m["hit"]),
    )
    return F.when(F.size(terms) > 0, found.cast(SORTED)).otherwise(F.array().cast(SORTED))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPANS)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets, removed terms by nothing."""
    upto = lambda i: F.aggregate(F.slice(spans, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, s["end"]))

    def piece(s, i):
        before = upto(i)
        plain = F.substring(text, (before + 1).cast("int"), (F.greatest(s["start"] - before, F.lit(0))).cast("int"))
        mark = F.when(s["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(plain, F.when(s["end"] > before, mark).otherwise(""))

    rest = F.substring(text, (upto(F.size(spans)) + 1).cast("int"), F.length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), rest)


def rated_terms(near: DataFrame, texts: DataFrame, terms: DataFrame, everywhere: bool) -> DataFrame:
    """``_key`` and the terms to ``generalise`` and to ``remove`` in the row's text, of the rows that have any."""
    if everywhere:
        words = texts.select("_key", F.explode(_terms(F.col("_text"))).alias("term"))
        own = words.join(terms.groupBy("term").agg(F.max("action").alias("action")), "term")
    else:
        named = near.select("_key", "entity").distinct()
        texts = texts.join(named.select("_key").distinct(), "_key", "left_semi")
        words = texts.select("_key", F.explode(_terms(F.col("_text"))).alias("term"))
        own = words.join(terms, "term").join(named, ["_key", "entity"])
    own = own.groupBy("_key", "term").agg(F.max("action").alias("action"))
    lists = [F.collect_set(F.when(F.col("action") == a, F.col("term"))).alias(a) for a in ("generalise", "remove")]
    return own.groupBy("_key").agg(*lists)


def sanitise(
    df: DataFrame, support: int = 3, generalise_at: float = 0.9, remove_at: float = 0.97, id_col: str = "doc_id",
    text_col: str = "text", everywhere: bool = False,
) -> DataFrame:
    """Id, ``base`` and ``spans`` (arrays of kind, start, end) and ``text``, the sanitised text, null where nothing
    was found and the text stays as it is. A disclosing term is looked for in the whole texts that mention its
    entity, with ``everywhere`` in all texts."""
    spark = df.sparkSession
    folder = run_dir(spark, "pii")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    text = F.coalesce(text_col, F.lit(""))
    texts = df.select(F.col(id_col).alias("_id"), row_hash(id_col, text_col).alias("_key"), text.alias("_text"))
    found = texts.select("_id", "_key", base_spans(F.col("_text")).alias("base"), "_text")
    found = stored(found.withColumn("_text", F.when(F.size("base") > 0, F.col("_text"))), "found")
    near = stored(mentions(found), "near")
    terms = stored(disclosing(near, distinct_lines(texts), support, generalise_at, remove_at), "terms")
    own = stored(rated_terms(near, texts, terms, everywhere), "own")

    # Rows with terms come from the input, since texts without base spans are not stored.
    rows = texts.join(own, "_key").withColumn("base", base_spans(F.col("_text")))
    added = [_term_spans(F.col("_text"), F.col("base"), F.col(a), a) for a in ("generalise", "remove")]
    rows = rows.select("_id", "base", "_text", F.array_sort(F.concat("base", *added)).alias("spans"))
    rest = found.join(own, "_key", "left_anti").select("_id", "base", "_text", F.col("base").alias("spans"))
    both = rest.unionByName(rows)
    return both.select(
        F.col("_id").alias(id_col),
        _plain(F.col("base")).alias("base"),
        _plain(F.col("spans")).alias("spans"),
        F.when(F.size("spans") > 0, replaced(F.col("_text"), F.col("spans"))).alias("text"),
    )
