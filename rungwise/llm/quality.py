"""Quality rules, line first: lines fail rules, failed lines go, documents that lose too much go.

Native: everything is a DataFrame expression; a document's lines and word windows stay arrays inside
its row, so that the operator needs no shuffle and a hot source cannot skew it.

Rules for a line that holds a word (blank lines are kept and count for nothing):

* punctuation: four or more words that don't end in closing punctuation;
* navigation: two or more bars, an arrow or angle mark, or a bare link word;
* boilerplate: a phrase of legal, cookie, script or sign-up notices in English, French, German or Spanish;
* symbols: a tenth or more of its word characters are symbols;
* shouting: ten or more letters of which over half are capitals.

Defined results: null and empty texts have no words, fail the base rule and are not kept; a text of
any length is judged whole; equal rows give equal rows; other columns stay out of the way, since only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import SPACES, WORD_CLASS, n_words, table, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents that lose more than this share of their word characters are rejected.
MAX_LOST_PERCENT = 50

SYMBOLS = "#*$%&|<>"
CLOSING = tuple(".!?…:;\"'”’»)]")
BARS, ARROWS = r"\|.*\|", tuple("→»›")
# Link words and notices in the corpus's languages.
LINKS = (
    "home", "menu", "next", "previous", "back", "search", "login", "contact", "accueil", "suivant", "précédent", "recherche", "connexion",
    "startseite", "menü", "weiter", "zurück", "suche", "anmelden", "kontakt", "inicio", "menú", "siguiente", "anterior", "buscar", "contacto",
)
BOILERPLATE = (
    "all rights reserved", "copyright", "privacy policy", "cookie", "terms of use", "terms of service", "javascript",
    "lorem ipsum", "subscribe", "sign up", "click here", "license under", "licensed under", "spdx-license",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "alle rechte vorbehalten", "datenschutzerklärung",
    "nutzungsbedingungen", "todos los derechos reservados", "política de privacidad", "aviso legal",
)


def _any_of(text: Column, parts) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def _visible(text: Column) -> Column:
    """Number of code points other than ASCII white space."""
    return F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text))


def _symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[" + SYMBOLS + "]"))


def _guards(text: Column) -> dict[str, Column]:
    """What some line must hold for a rule to fail it; few texts have any, so few lines are searched."""
    return {"_boilerplate": _any_of(F.lower(text), BOILERPLATE), "_bars": F.contains(text, F.lit("|")), "_arrows": _any_of(text, ARROWS)}


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule; a line without a word never does. Needs the columns of the guards."""
    closed = F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).isin(*CLOSING)
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    letters = F.length(line) - F.regexp_count(line, F.lit(r"\P{L}"))
    # Ten letters of which over half are capitals are six capitals at least.
    shouting = (capitals >= 6) & (letters >= 10) & (capitals * 2 > letters)
    symbols = _symbol_count(line)
    return line.rlike(WORD_CLASS) & (
        (~closed & (n_words(line) >= 4))
        | (F.col("_bars") & line.rlike(BARS))
        | (F.col("_arrows") & _any_of(line, ARROWS))
        | F.btrim(F.lower(line), F.lit(SPACES)).isin(*LINKS)
        | (F.col("_boilerplate") & _any_of(F.lower(line), BOILERPLATE))
        | ((symbols > 0) & (symbols * 10 >= _visible(line)))
        | shouting
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cleaned`` (the text without its failed lines) and ``n_failed_lines``, ``lost_chars``.

    Columns of these names, and those that begin with ``_`` and name the guards, are replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    guarded = docs.withColumns(_guards(whole) | {"_lines": F.split(whole, "\n", -1)})
    out = guarded.withColumn("_failed", F.transform("_lines", line_fails)).drop("_boilerplate", "_bars", "_arrows")
    at = F.arrays_zip("_lines", "_failed")
    good = F.transform(F.filter(at, lambda x: ~x["_failed"]), lambda x: x["_lines"])
    bad = F.filter(at, lambda x: x["_failed"])
    return (
        out.withColumn("cleaned", F.array_join(good, "\n"))
        .withColumn("n_failed_lines", F.size(bad).cast("long"))
        .withColumn("lost_chars", F.aggregate(bad, F.lit(0).cast("long"), lambda n, x: n + _visible(x["_lines"])))
        .drop("_failed", "_lines")
    )


def repeated_words(docs: DataFrame, words: str = "words", out: str = "n_repeat_words") -> DataFrame:
    """Replaces an array of words by the number of words that lie in a window of WINDOW words found twice or more in the text.

    A window's key is a 64-bit hash of its words' hashes; sorting the keys brings equal ones together,
    the positions found are sorted again, and every one adds the words that the last hadn't covered.
    """
    hashes = docs.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    keys = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    found = hashes.withColumn("_keys", keys).drop("_words")
    twice = F.size(F.array_distinct("_keys")) < F.size("_keys")
    located = F.sort_array(F.transform("_keys", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    placed = found.withColumn("_at", F.when(twice, located)).drop("_keys")
    here = lambda e, j: F.when((F.get(F.col("_at"), j - 1)["x"] == e["x"]) | (F.get(F.col("_at"), j + 1)["x"] == e["x"]), e["i"])
    starts = F.sort_array(F.filter(F.transform("_at", here), lambda i: i.isNotNull()))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(starts, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return placed.withColumn(out, F.when(F.col("_at").isNull(), F.lit(0)).otherwise(total).cast("long")).drop("_at")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the lines' losses, base_failed and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CLASS))
    counted = docs.select("doc_id", text.alias("text"), words_of(text).alias("words")).select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _symbol_count(text).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    judged = clean(repeated_words(counted)).drop("text", "cleaned")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# The rules once more, as patterns for the SQL.
_CLOSING = r"""[.!?…:;"'”’»)\]][\x20\x09-\x0D]*$"""
_NAVIGATION = r"(\|.*\|)|[→»›]|^(home|menu|next|previous|back|search|login|contact|accueil|suivant|précédent|recherche|connexion|startseite|menü|weiter|zurück|suche|anmelden|kontakt|inicio|menú|siguiente|anterior|buscar|contacto)$"
_BOILERPLATE = r"tous droits réservés|politique de confidentialité|mentions légales|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|todos los derechos reservados|política de privacidad|aviso legal|all rights reserved|copyright|privacy policy|cookie|terms of (use|service)|javascript|lorem ipsum|subscribe|sign up|click here|licensed? under|spdx-license"

_W, _S = r"'[^\x20\x09-\x0D]+'", r"'[\x20\x09-\x0D]+'"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, {_W}) AS ws FROM d),
x AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
v AS (SELECT rid, i, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win,
        count(*) OVER (PARTITION BY rid) AS n FROM x),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM v WHERE i <= n - {WINDOW - 1}) WHERE c > 1),
r AS (SELECT rid, sum(least({WINDOW}, i - coalesce(lag_i, i - {WINDOW}))) AS n_repeat_words FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS lag_i FROM p) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, line, length(regexp_replace(line, {_S}, '', 'g')) AS chars, len(regexp_extract_all(line, {_W})) AS n,
        length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) AS capitals,
        length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols FROM l WHERE regexp_matches(line, {_W})),
f AS (SELECT rid, line, chars, (n >= 4 AND NOT regexp_matches(line, {_sql(_CLOSING)}))
        OR regexp_matches(regexp_replace(regexp_replace(lower(line), '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), {_sql(_NAVIGATION)})
        OR regexp_matches(lower(line), {_sql(_BOILERPLATE)}) OR symbols * 10 >= chars OR (letters >= 10 AND capitals * 2 > letters) AS bad FROM m),
g AS (SELECT rid, count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost_chars, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY rid),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, {_S}, '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN g USING (rid)),
e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept FROM e
"""
