"""Line-first quality rules, in column expressions only.

Each line of a text is held against rules on its punctuation, on navigation and on
boilerplate; lines that fail are taken out, and a document that loses too much of its text,
or keeps too few words, is rejected. Base measures of the whole text (words, symbols,
repeated lines, repeated 8-word windows) are computed beside it, and a document that fails
those is rejected whatever its lines.

Windows are compared by 64-bit hashes within one document. A document whose windows are all
different (most are) costs one pass; only others sort their windows. Every step works inside
the row: nothing is shuffled and nothing is cut short.

Defined cases: null and blank texts have no words, fail the base rules and are not kept;
repeated rows are judged each; other columns pass by untouched (the result carries the
documents' own columns only where clean() is asked for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, which characters count as symbols, and the phrases of boilerplate lines.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LINE_END = r"[.!?:;,…\"'”’»)\]]$"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript",
    "subscribe to our", "sign up for", "click here", "powered by", "lorem ipsum", "skip to content", "share this",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies", "cliquez ici", "abonnez-vous", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "aceptar cookies", "haga clic aquí", "haz clic aquí", "suscríbete", "saltar al contenido",
)
# Words of menus, and beginnings of links.
MENU = (
    "home", "about", "contact", "login", "register", "search", "menu", "sitemap", "faq", "help", "blog", "shop", "cart", "news",
    "startseite", "kontakt", "impressum", "anmelden", "suche", "warenkorb", "hilfe",
    "accueil", "connexion", "recherche", "panier", "aide", "inicio", "contacto", "buscar", "acceso", "carrito", "ayuda",
)
LINK = ("http://", "https://", "www.")
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once and only where this expression is evaluated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def occurrences(text: Column, characters: str) -> Column:
    """How many of its characters are among the given ones."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words which occurs twice or more in the list."""
    n = F.size(words)
    # Elements are taken one by one: slice() copies the whole list each time.
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(hashed: Column) -> Column:
        placed = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.transform(s, lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]))
            return F.array_sort(F.filter(again, lambda i: i.isNotNull()))

        return let(
            let(placed, starts),
            lambda at: F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")),
                lambda acc: acc["n"],
            ),
        )

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < window, F.lit(0)).otherwise(found).cast("bigint")


def line_fails(line: Column, words: Column) -> Column:
    """True if a line with words breaks a rule on punctuation, navigation or boilerplate."""
    n = F.size(words).cast("bigint")
    symbols = occurrences(line, SYMBOLS)
    bars = occurrences(line, "|»›")
    shouts = occurrences(line, "!")
    low = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)
    distinct = F.size(F.array_distinct(words)).cast("bigint")
    punctuation = (symbols * 2 > n) | ((shouts >= 4) & (shouts * 4 > n)) | (~line.rlike(r"\p{Ll}") & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= 10))
    fragment = (n < 4) & ~line.rlike(LINE_END)
    menu = F.size(F.filter(words, lambda w: F.lower(w).isin(*MENU)))
    begins = lambda w: F.lower(w).startswith(LINK[0]) | F.lower(w).startswith(LINK[1]) | F.lower(w).startswith(LINK[2])
    some = low.contains(LINK[0]) | low.contains(LINK[1]) | low.contains(LINK[2])  # words are looked at only where there is a link
    links = F.when(some, F.size(F.filter(words, begins))).otherwise(0)
    navigation = ((bars >= 3) & (bars * 4 > n)) | ((menu >= 3) & (menu * 2 > n)) | (links * 2 > n)
    return punctuation | fragment | navigation | ((n <= 30) & phrase) | ((n >= 10) & (distinct * distinct < n))


def quality_of(text: Column, most_lost: float = 0.3, least_words: int = 20, most_repeated: float = 0.3) -> Column:
    """A struct of the measures of a text, its cleaned form and the verdict: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, line_chars, lost_chars, kept_words,
    cleaned (lines that pass, joined by line feeds)."""
    text = F.coalesce(text, F.lit(""))
    # Values used more than once are bound by let(): the optimizer would write a struct's fields
    # out at each use, and words would be split again for each window.
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda l: F.struct(l.alias("l"), words_of(l).alias("w"))),
        lambda e: F.size(e["w"]) > 0,
    )
    marked = F.transform(lines, lambda e: F.struct(e["l"].alias("l"), F.size(e["w"]).alias("n"), line_fails(e["l"], e["w"]).alias("bad")))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")))

    def of_lines(found: Column) -> Column:
        def total(of) -> Column:
            return F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, e: acc + of(e))

        texts = F.transform(found, lambda e: e["l"])
        return F.struct(
            (F.size(texts) - F.size(F.array_distinct(texts))).cast("bigint").alias("n_dup_lines"),
            total(lambda e: F.when(e["bad"], 1).otherwise(0)).alias("n_failed_lines"),
            total(lambda e: F.length(e["l"])).alias("line_chars"),
            total(lambda e: F.when(e["bad"], F.length(e["l"])).otherwise(0)).alias("lost_chars"),
            total(lambda e: F.when(e["bad"], 0).otherwise(e["n"])).alias("kept_words"),
            F.array_join(F.transform(F.filter(found, lambda e: ~e["bad"]), lambda e: e["l"]), "\n").alias("cleaned"),
        )

    measures = F.struct(
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        occurrences(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        of_words.alias("words"),
        let(marked, of_lines).alias("lines"),
    )
    fields = {k: (lambda m, k=k: m[k]) for k in ("word_chars", "n_symbols")}
    fields |= {k: (lambda m, k=k: m["words"][k]) for k in ("n_words", "n_repeat_words")}
    fields |= {k: (lambda m, k=k: m["lines"][k]) for k in ("n_dup_lines", "n_failed_lines", "line_chars", "lost_chars", "kept_words", "cleaned")}

    def verdict(m: Column) -> Column:
        n = m["words"]["n_words"]
        base_failed = (n < least_words) | (m["words"]["n_repeat_words"] * 100 > n * int(round(most_repeated * 100)))
        passes = (m["lines"]["lost_chars"] * 100 <= m["lines"]["line_chars"] * int(round(most_lost * 100))) & (m["lines"]["kept_words"] >= least_words)
        return F.struct(*[get(m).alias(k) for k, get in fields.items()], base_failed.alias("base_failed"), (~base_failed & passes).alias("kept"))

    return let(measures, verdict)


def judge(docs: DataFrame, text_column: str = "text", into: str = "quality", **limits) -> DataFrame:
    """docs plus a struct column of measures and verdict (`quality` by default; a column of that name is replaced)."""
    return docs.withColumn(into, quality_of(F.col(text_column), **limits))


def clean(docs: DataFrame, text_column: str = "text", **limits) -> DataFrame:
    """The documents that pass, with their failed lines taken out; the columns of docs."""
    # A list of one or no verdict is exploded: a filter would be pushed below the projection, and everything computed twice.
    own = "__line_quality"
    passed = F.filter(F.array(quality_of(F.col(text_column), **limits)), lambda q: q["kept"])
    d = docs.withColumn(own, F.explode(passed))
    return d.withColumn(text_column, F.col(own)["cleaned"]).select(*docs.columns)
