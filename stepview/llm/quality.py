"""Quality rules: divergence of a document's histograms from its language.

Two histograms of each whole text, of character classes and of the language's most
common words, are compared with the sums over all documents of that language by
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A distance
above its threshold rejects the document, but only where the text is long enough
for its histogram to say something: shorter ones pass. Before that, basic rules reject
texts with too few words or too many repeated passages.

Everything is DataFrame expressions over one row at a time; the only aggregation is the
sums of the references, at most one row for each known language and one for the rest.

Cases: a null text has no words (rejected as too short); a null or unknown
language is compared, in characters only, with the sum of all such documents;
repeated rows and ties are judged alike; an empty table has no references and gives no
rows; columns with any names pass through ``filtered`` untouched. A text may be of any length.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.llm.shared import col

#: White space between words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window (hashed by doubling, so a power of two); least words; most percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Character classes in the order in which they are taken out of a text; the rest is a class too.
CLASSES = {
    "lower": r"\p{Ll}+",
    "space": SPACE + "+",
    "upper": r"\p{Lu}+",
    "stops": r"[.,;:!?]+",
    "digits": r"[0-9]+",
    "symbols": SYMBOLS + "+",
    "quotes": r"['\"()\[\]{}/_+=@-]+",
}
#: The most common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au il".split(),
}
#: Characters and words from which on a histogram counts; the largest distances that pass.
GUARD_CHARS, GUARD_WORDS = 300, 40
MOST_CHARS, MOST_WORDS = 0.3, 0.23
#: Of n words drawn from the reference itself, the distance is about 1.5 / sqrt(n); more than this over sqrt(n) is far.
SLACK = 3.4


def features(docs: DataFrame, key: list[str], text: str, lang: str, repeats: bool = True) -> DataFrame:
    """``row`` (a struct of the columns in ``key``), ``lang``, ``chars`` and ``common`` (counts), and the base figures."""
    body = F.coalesce(col(text), F.lit(""))
    known = F.when(col(lang).isin(*COMMON), col(lang)).otherwise("")
    d = docs.select(F.struct(*[col(c) for c in key]).alias("row"), body.alias("text"), known.alias("lang"))
    kept = ["row", "text", "lang"]
    rest, counts = F.col("text"), []
    for i, pattern in enumerate(CLASSES.values()):
        left = F.regexp_replace(rest, pattern, "")
        d = d.withColumn(f"rest{i}", left)
        counts.append(F.length(rest) - F.length(f"rest{i}"))
        rest = F.col(f"rest{i}")
    d = d.select(*kept, F.transform(F.array(*counts, F.length(rest)), lambda x: x.cast("bigint")).alias("chars"))
    d = d.withColumn("spaced", F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "  "))
    gaps = (F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.lit("  "), F.lit("")))) / 2
    at_ends = F.startswith(F.col("spaced"), F.lit("  ")).cast("int") + F.endswith(F.col("spaced"), F.lit("  ")).cast("int")
    letters = F.when(F.col("spaced") == "", 0).otherwise(gaps + 1 - at_ends).cast("bigint")
    # Only words as short as the common ones are searched.
    longest = max(len(w) for words in COMMON.values() for w in words)
    short = F.concat(F.lit(" "), F.regexp_replace("spaced", rf"\p{{L}}{{{longest + 1},}}", ""), F.lit(" "))
    d = d.select(*kept, "chars", letters.alias("letters"), short.alias("spaced"))
    first, *others = COMMON
    counted = lambda x: F.array(*[_occurs(w) for w in COMMON[x]])
    common = functools.reduce(lambda e, x: e.when(F.col("lang") == x, counted(x)), others, F.when(F.col("lang") == first, counted(first)))
    d = d.select(*kept, "chars", common.alias("hits"), "letters")
    rest_of = F.col("letters") - F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.select(*kept, "chars", F.concat("hits", F.array(rest_of)).alias("common"), "letters")
    if not repeats:
        return d.drop("text")
    words = F.regexp_extract_all("text", F.lit("(" + SPACE.replace("[", "[^") + "+)"), F.lit(1))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    d = d.withColumns({"words": words, "lines": lines})
    n = F.size("words")
    d = d.select(
        "row", "lang", "chars", "common", "letters",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Hashes of 2, 4 and 8 words, each from two of the step before. Every step is a column that is used twice: one that is
    # used once would be copied into the function and worked out again for each of its elements.
    for name, of, apart in (("two", "hashes", 1), ("four", "two", 2), ("windows", "four", 4)):
        shifted = F.slice(of, apart + 1, F.greatest(F.size(of) - apart, F.lit(0)))
        d = d.withColumn(name, F.zip_with(of, shifted, lambda a, b: F.xxhash64(a, b))).drop(of)
    d = d.withColumn("windows", F.slice("windows", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))))
    # Few texts repeat a window; only those are sorted.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(twice, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("windows")
    same = lambda s, i: (F.get("sorted", i - 1)["x"] == s["x"]) | (F.get("sorted", i + 1)["x"] == s["x"])
    found = F.filter("sorted", lambda s, i: F.coalesce(same(s, i), F.get("sorted", i - 1)["x"] == s["x"], F.get("sorted", i + 1)["x"] == s["x"], F.lit(False)))
    d = d.withColumn("at", F.sort_array(F.transform(found, lambda s: s["i"]))).drop("sorted")
    covered = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1), x + WINDOW) - x))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint")
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop("at")


def _occurs(word: str) -> Column:
    """How often a word stands in ``spaced``, where two blanks divide words."""
    size = len(word.encode()) + 2
    return ((F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.lit(f" {word} "), F.lit("")))) / size).cast("bigint")


def references(docs: DataFrame, text: str, lang: str) -> dict[str, tuple[list[int] | None, list[int] | None]]:
    """Per known language, and "" for the rest: sums of the histograms over all documents. At most five rows."""
    each = features(docs, [], text, lang, repeats=False)
    n_words = max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))) for i in range(len(CLASSES) + 1)]
    words = [F.sum(F.get("common", F.lit(i))) for i in range(n_words)]
    rows = each.groupBy("lang").agg(F.array(*sums).alias("chars"), F.array(*words).alias("common")).collect()
    return {r["lang"]: (r["chars"], [x for x in r["common"] if x is not None] or None) for r in rows}


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; NULL where one is missing or empty."""
    whole = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = lambda c: F.transform(c, lambda x: x / whole(c))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(share(counts), share(reference), lambda p, q: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def judged(docs: DataFrame, key: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``row``, the base figures, both distances (NULL where a guard holds), ``base_failed`` and ``kept``."""
    found = references(docs, text, lang)

    def of(which: int) -> Column:
        out = F.lit(None).cast("array<bigint>")
        for name, sums in found.items():
            if sums[which]:
                out = F.when(F.col("lang") == name, F.array(*[F.lit(x).cast("bigint") for x in sums[which]])).otherwise(out)
        return out

    d = features(docs, key, text, lang).withColumns({"q_chars": of(0), "q_common": of(1)})
    n_chars = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.withColumns(
        {
            "char_distance": F.when(n_chars >= GUARD_CHARS, distance(F.col("chars"), F.col("q_chars"))),
            "word_distance": F.when(F.col("letters") >= GUARD_WORDS, distance(F.col("common"), F.col("q_common"))),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        }
    )
    far = F.coalesce(F.col("char_distance") > MOST_CHARS, F.lit(False)) | F.coalesce(F.col("word_distance") > F.greatest(F.lit(MOST_WORDS), SLACK / F.sqrt("letters")), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~far)


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Figures and verdict of every row."""
    d = judged(docs, [key], text, lang)
    return d.select(
        F.col("row")[key].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"),
    )


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, as they are."""
    # A filter is pushed below projections by copying their expressions into it, here each of them many
    # times; it stays above one that numbers the rows.
    d = judged(docs, docs.columns, text, lang).select("row", "kept", F.monotonically_increasing_id().alias("number"))
    return d.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")


def _sql() -> str:
    """The same in DuckDB's SQL."""
    not_space = SPACE.replace("[", "[^")
    chain, last = "SELECT doc_id, t, l FROM d", "t"
    for i, pattern in enumerate(CLASSES.values()):
        quoted = pattern.replace("'", "''")
        chain = f"SELECT *, regexp_replace({last}, '{quoted}', '', 'g') AS r{i} FROM ({chain})"
        last = f"r{i}"
    steps = ["t", *(f"r{i}" for i in range(len(CLASSES)))]
    chars = ", ".join([f"length({a}) - length({b})" for a, b in zip(steps, steps[1:])] + [f"length({last})"])
    hits = " ".join(
        f"WHEN '{name}' THEN [{', '.join(f'''(length(spaced) - length(replace(spaced, ' {w} ', ''))) // {len(w) + 2}''' for w in words)}]"
        for name, words in COMMON.items()
    )
    n_words = max(map(len, COMMON.values())) + 1
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    def distance_of(c: str, q: str) -> str:
        a, b = f"({c}[i] / list_sum({c}))", f"({q}[i] / list_sum({q}))"
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({c}) + 1), lambda i: ({term(a)} + {term(b)}) / 2))))"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in COMMON)}) THEN lang ELSE '' END AS l FROM documents),
spaced AS (SELECT *, ' ' || regexp_replace(lower(t), '[^\\p{{L}}]+', '  ', 'g') || ' ' AS spaced, [{chars}] AS chars,
  regexp_extract_all(t, '{not_space}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{not_space}')) AS ls FROM ({chain})),
hit AS (SELECT *, CASE l {hits} END AS hits, len(regexp_extract_all(spaced, '\\p{{L}}+')) AS letters FROM spaced),
f AS (SELECT *, list_append(hits, letters - list_sum(hits)) AS common FROM hit),
q AS (SELECT l, {sums('chars', len(CLASSES) + 1)} AS qc, {sums('common', n_words)} AS qw FROM f GROUP BY l),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM f)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id),
g AS (SELECT f.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, letters,
  CASE WHEN length(t) >= {GUARD_CHARS} THEN {distance_of('chars', 'qc')} END AS dc,
  CASE WHEN letters >= {GUARD_WORDS} AND common IS NOT NULL THEN {distance_of('common', 'qw')} END AS dw
  FROM f JOIN q ON f.l = q.l LEFT JOIN repeats ON f.doc_id = repeats.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(dc > {MOST_CHARS}, false) AND NOT coalesce(dw > greatest({MOST_WORDS}, {SLACK} / sqrt(letters)), false) AS kept,
  round(dc, 4) AS char_distance, round(dw, 4) AS word_distance
FROM b
"""


SQL = _sql()
