"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much text is rejected.

A line fails as *navigation* if at least ``SEPARATORS`` per cent of its words are menu separators, as *noise* if as many
end in a run of marks (``word!!``, ``word%%%``), as *unfinished* if it has fewer than ``SHORT`` words and no closing
punctuation, and as *boilerplate* if it holds one of the phrases in ``BOILERPLATE``. Lines without a word are neither
judged nor removed. A document is kept if it isn't too short or repetitive (``base_failed``) and its failing lines hold
at most ``MAX_LOST`` per cent of its words.

Words are runs of characters other than the six ASCII spaces, lines are parted by line feeds. Everything is computed
from the row alone, so nothing is shuffled, a hot source or a repeated row costs no more than other rows, and columns
that the rules don't need (whatever their names) pass through. Null texts are empty: all counts 0, not kept. Very long
texts are taken whole; eight-word windows are compared by 64-bit hashes, which confuse two different windows of one text
of a million words with a probability of 3e-8. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
WINDOW = 8  #: words in a window that must not come back
MAX_REPEAT = 30  #: per cent of words in repeated windows
MAX_LOST = 50  #: per cent of words in failing lines
SEPARATORS = 20  #: per cent of a line's words that are separators, or end in marks
SHORT = 8  #: words from which a line may do without closing punctuation


RULES = ("navigation", "noise", "unfinished", "boilerplate")
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
ODD_SPACE = r"[\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"  #: what is not a symbol
MARKED = r"[!?#*$%&~=+_-]{2,}([\x20\x09-\x0D]|$)"  #: a word that ends in a run of marks
SEPARATOR = r"[|>»›·•/]([\x20\x09-\x0D]|$)"  #: a word that parts menu entries, or ends in such a part
ODD = r"[!?#*$%&~=+_|>»›·•/-]"  #: what lines that fail by separators or marks have
CLOSED = r"[.!?:;,…。！？][\"'»”’)\]]?$"
NOTICE = 200  #: characters up to which a line with a boilerplate phrase is a notice rather than prose
# Openings of phrases of page furniture and licence notices, matched in lower case behind a space.
BOILERPLATE = (
    r"[\x20\x09-\x0D(](?:a(?:ll rights reserved|lle rechte vorbehalten)|c(?:opyright|ookies?|lick here)|datenschutzerkl|impressum|javascript"
    r"|l(?:icen[cs]ed under|orem ipsum)|mentions légales|newsletter|pol[ií]tica de privacidad|privacy policy|released under"
    r"|s(?:ign (?:in|up)|ubscribe to)|t(?:erms of (?:use|service)|ous droits réservés|odos los derechos))\b"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """The words in order. A split at one plain character needs no pattern, which is faster."""
    return F.array_remove(F.split(F.regexp_replace(text, ODD_SPACE, " "), " "), "")


def window_hashes(hashes: Column, window: int = WINDOW) -> Column:
    """A hash of each run of ``window`` words (a power of two) from the words' hashes: runs of 1, 2, 4, ... words."""

    def doubled(k: int) -> Callable[[Column], Column]:
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))

    n, k = F.size(hashes), 1
    while k < window:
        hashes, k = bind(hashes, doubled(k)), 2 * k
    return F.slice(hashes, F.lit(1), F.greatest(n - (window - 1), F.lit(0)))


def count_repeated(windows: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window whose hash comes twice or more in the array ``windows``."""

    def places(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k + 1) | near(x, k - 1)), lambda x: x["i"]))

    def span(p: Column) -> Column:  # a window adds what the next one doesn't cover too
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bind(bind(pairs, places), span))


def line_verdict(line: Column) -> Column:
    """The rule a line fails, or null. The words of a line are counted only where a rule needs their number."""

    def judge(x: Column) -> Column:
        n = F.size(F.split(x, GAP))
        often = lambda pattern: F.regexp_count(x, F.lit(pattern)) * 100 >= n * SEPARATORS
        closed = F.right(x, F.lit(2)).rlike(CLOSED)
        notice = F.when(F.length(x) <= NOTICE, F.concat(F.lit(" "), F.lower(x)).rlike(BOILERPLATE))
        odd = F.when(often(SEPARATOR), F.lit("navigation")).when(often(MARKED), F.lit("noise"))
        return F.coalesce(
            F.when(x.rlike(ODD), odd),
            F.when(~closed & (x != "") & (n < SHORT), F.lit("unfinished")),
            F.when(notice, F.lit("boilerplate")),
        )

    return bind(F.btrim(line, F.lit(SPACES)), judge)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with counts, the rules its lines failed, the text without those lines, and the verdict.

    Added columns (any of these names that ``docs`` has is replaced): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lost_words, failed_rules (a map from rule to the number of lines), base_failed, kept, cleaned.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "failed_rules", "base_failed", "kept", "cleaned"]
    hidden = ["_text", "_hashes", "_windows", "_lines"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*added, *hidden}]
    text = F.col("_text")
    # Every step is a projection of its own: arrays named more than once are made once.
    whole = docs.select(*rest, F.coalesce("text", F.lit("")).alias("_text"))
    hashes = F.transform(split_words(text), lambda w: F.xxhash64(w))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_verdict(x).alias("failed")))
    made = whole.select("*", hashes.alias("_hashes"), lines.alias("_lines"))
    made = made.select("*", window_hashes(F.col("_hashes")).alias("_windows"))
    spoken = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    failing = F.filter("_lines", lambda x: x["failed"].isNotNull())
    sound = F.filter("_lines", lambda x: x["failed"].isNull())
    joined = lambda f: F.array_join(F.transform(f, lambda x: x["line"]), "\n")
    failed = lambda rule: lambda x: x["failed"] == F.lit(rule)
    counted = made.select(
        *rest,
        F.size("_hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace(F.replace(text, F.lit(" ")), ODD_SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        bind(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        count_repeated(F.col("_windows")).cast("long").alias("n_repeat_words"),
        bind(failing, lambda f: F.when(F.size(f) == 0, F.lit(0)).otherwise(F.size(split_words(joined(f))))).cast("long").alias("lost_words"),
        bind(failing, lambda f: F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*(F.size(F.filter(f, failed(r))) for r in RULES)))).alias("failed_rules"),
        joined(sound).alias("cleaned"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    kept = ~base & (F.col("lost_words") * 100 <= F.col("n_words") * MAX_LOST)
    return counted.select(*rest, *added[:7], base.alias("base_failed"), kept.alias("kept"), "cleaned")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their cleaned text and its length, and the columns of ``docs``."""
    found = clean(docs).filter("kept")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns if c in found.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per row of ``docs``."""
    found = clean(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")
