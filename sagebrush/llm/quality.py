"""Line-first quality rules, with DataFrame and SQL functions only.

Each line is judged on its own: it fails if it is navigation (many separators),
symbol junk, boilerplate (phrases of page furniture make up a third of it), or
lacks sentence punctuation: a line of fewer than LONG_LINE words must end in a
sentence mark, a longer one hold one.  Failed lines are taken out, and a document
that loses more than ``max_lost`` of its characters is rejected, as is one that
fails the base rules (fewer than 20 words, or over 30 % of its words inside 8-word
windows that occur twice or more).

Null text is an empty document: all counts 0, base_failed.  Everything is
computed row by row without a shuffle, so skew, ties and repeated rows do not
matter; each input row gives one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import own_names

#: Word separators: space and \t to \r.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Phrases of page furniture, in lower case: English, French, German, Spanish.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "lorem ipsum", "privacy policy", "share this", "sign in", "sign up", "subscribe to", "terms of service", "terms of use",
    "accepter les cookies", "cliquez ici", "haut de page", "mentions légales", "se connecter",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "nach oben", "nutzungsbedingungen",
    "aceptar cookies", "aviso legal", "haga clic", "iniciar sesión", "política de privacidad", "todos los derechos reservados",
)
#: Marks that end a sentence, or a clause before a list, in the common scripts.
MARKS = ".!?:;…。！？；：।؟۔"
LONG_LINE = 10
END = rf"[{MARKS}][\"'”’»)\]]*[\x20\x09-\x0D]*$"
PHRASE = rf"(?i)\b({'|'.join(BOILERPLATE)})\b"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _occurrences(text: Column, characters: str) -> Column:
    """Of one-byte characters: the bytes that go as each is removed."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total


def line_fails(line: Column, with_symbols: Column, with_phrases: Column) -> Column:
    """The verdict on one line, which has a word.  The two flags say whether the
    document has any symbols and phrases; where not, their rules are skipped."""
    words = F.size(_words(line))
    left = F.regexp_replace(line, PHRASE, "")
    boilerplate = with_phrases & (F.lit(3) * (F.length(line) - F.length(left)) >= F.length(line))
    navigation = _occurrences(line, "|>") * 4 >= words
    symbols = _occurrences(line, SYMBOLS) * 4 >= words
    marked = F.regexp_like(line, F.lit(f"[{MARKS}]"))
    no_sentence = ~F.regexp_like(line, F.lit(END)) & (~marked | (words < LONG_LINE))
    return no_sentence | boilerplate | (with_symbols & (navigation | symbols))


NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_chars", "kept", "clean_text")


def quality(docs: DataFrame, text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_failed_lines, lost_chars, kept and clean_text (the
    text without its failed lines).  Columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in NEW])
    words, hashes, windows, all_, good, phrases = own_names(docs, "_words", "_hashes", "_windows", "_lines", "_good", "_phrases")
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast("array<bigint>")
    chars = lambda c: F.length(F.array_join(c, ""))
    step = docs.withColumn(words, _words(text))
    step = step.withColumns({"n_words": F.size(words).cast("long"), "word_chars": chars(words).cast("long"), hashes: F.transform(words, lambda w: F.xxhash64(w))})
    eight = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    step = step.withColumn(windows, F.when(F.col("n_words") >= WINDOW, eight).otherwise(none)).drop(words, hashes)
    once = F.size(F.array_distinct(windows)) == F.size(windows)
    step = step.withColumn("n_repeat_words", F.when(once, F.lit(0)).otherwise(_covered(F.col(windows))).cast("long")).drop(windows)
    lower, some = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        some = some | F.contains(lower, F.lit(phrase))
    solid = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    step = step.withColumns({all_: solid, "n_symbols": _occurrences(text, SYMBOLS).cast("long"), phrases: some})
    step = step.withColumn(good, F.filter(all_, lambda x: ~line_fails(x, F.col("n_symbols") > 0, F.col(phrases))))
    step = step.withColumns(
        {
            "n_dup_lines": (F.size(all_) - F.size(F.array_distinct(all_))).cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")),
            "n_lines": F.size(all_).cast("long"),
            "n_failed_lines": (F.size(all_) - F.size(good)).cast("long"),
            "lost_chars": (chars(all_) - chars(good)).cast("long"),
        }
    )
    verdict = ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(max_lost) * chars(all_))
    return step.withColumn("kept", verdict).withColumn("clean_text", F.array_join(good, "\n")).select(*docs.columns, *NEW)


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, given the hashes of all
    windows: each start of a repeated window adds the words that the start
    before it does not cover.  Only reached where some window occurs twice."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one pass over the sorted pairs keeps the starts whose hash equals a neighbour's
    empty = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("i"))
    before = F.concat(F.array(empty), F.slice(pairs, 1, F.size(pairs) - 1))
    after = F.concat(F.slice(pairs, 2, F.size(pairs) - 1), F.array(empty))
    hits = F.filter(
        F.zip_with(F.zip_with(pairs, before, lambda p, b: F.struct(p["h"].alias("h"), p["i"].alias("i"), F.coalesce(p["h"] == b["h"], F.lit(False)).alias("t"))), after, lambda p, a: F.when(p["t"] | F.coalesce(p["h"] == a["h"], F.lit(False)), p["i"])),
        lambda i: i.isNotNull(),
    )
    starts = F.sort_array(hits)
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["sum"] + F.least(F.lit(WINDOW), s - a["last"])).alias("sum"), s.alias("last")),
        lambda a: a["sum"],
    )
    return total
