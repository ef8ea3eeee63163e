"""Prompt -> keywords, text -> tokens, keywords -> pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_KEYWORD_LENGTH = 2
# Fixed value: keywords the original rule takes from a prompt.
MAX_KEYWORDS = 20

# Words never used as keywords.
STOP_WORDS = frozenset(
    """
    a an the
    and but or nor for yet so
    at by from in into of off on onto out over to up with about after before between during
    through under without
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those
    am is are was were be been being have has had having do does did doing will would could
    should might must shall can may
    here there when where why how all each every both few more most other some such no not only
    same than too very just also now then
    any anything anyone anybody everything everyone everybody something someone somebody nothing
    none nobody
    really actually basically probably maybe perhaps certainly definitely always never sometimes
    often usually still already even ever
    people think know want need like get make see look say said go going come coming take give
    find tell told use using work thing things time way lot good new first last long great little
    own well back year day much many
    """.split()
)

# Fixed value: characters that separate words of a prompt. Java's \s is ASCII only, so the
# Unicode spaces are listed with it.
_SEPARATORS = r"""[\s\x{feff}\p{Z},.!?;:'"()\[\]{}<>/\\|@#$%^&*+=~`\-_]+"""
# Hashtags, plain words and pattern characters.
_HASHTAG = r"#([a-zA-Z0-9_]+)"
_PLAIN_WORD = r"^[a-zA-Z0-9]+$"
_NON_WORD = r"[^A-Za-z0-9_]+"
_META = r"[.*+?^${}()|\[\]\\]"


def extract_keywords(prompt: Column | str, max_keywords: int | None = None) -> Column:
    """Hashtags first, then the plain words that are no stop words; all, or the first ``max_keywords``."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    tags = F.transform(F.regexp_extract_all(prompt, F.lit(_HASHTAG), F.lit(1)), F.lower)
    words = F.filter(
        F.split(F.lower(prompt), _SEPARATORS),
        lambda w: (F.length(w) >= MIN_KEYWORD_LENGTH)
        & ~w.isin(*sorted(STOP_WORDS))
        & w.rlike(_PLAIN_WORD)
        & ~F.array_contains(tags, w),
    )
    found = F.concat(tags, words)
    return found if max_keywords is None else F.slice(found, 1, max_keywords)


def word_list(text: Column | str) -> Column:
    """Lower-cased ASCII words of a text, in order, with repeats.

    The Kelvin sign and the dotted capital I are no ASCII letters, but their lower case is or
    starts with one; they are blanked first so that they keep separating words.
    """
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.lower(F.regexp_replace(text, r"[\x{212A}\x{130}]", " "))
    return F.regexp_extract_all(lowered, F.lit("([a-z0-9_]+)"), F.lit(1))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(word_list(text))


def gap_set(text: Column | str) -> Column:
    """The distinct non-word runs of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_NON_WORD})"), F.lit(1)))


def is_plain(keyword: Column) -> Column:
    return keyword.rlike("^[A-Za-z0-9_]+$")


def anchor_token(keyword: Column) -> Column:
    """A token every text matching ``keyword`` as a whole word must contain.

    All word runs inside a keyword end at a non-word character or at a required boundary, so
    the longest one is a full token of the text. A keyword without word characters needs a word
    character on both sides, hence is itself a full non-word run.
    """
    words = word_list(keyword)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.coalesce(longest["w"], keyword)


def _bounded_literal(keyword: Column) -> Column:
    escaped = F.regexp_replace(keyword, _META, r"\\$0")
    # Letters beyond ASCII match in either case; (?i) alone covers ASCII only.
    chars = F.transform(
        F.split(escaped, ""),
        lambda c: F.when(
            ~c.rlike(r"^[\x00-\x7f]*$") & (F.lower(c) != F.upper(c)),
            F.concat(F.lit("(?:"), F.lower(c), F.lit("|"), F.upper(c), F.lit(")")),
        ).otherwise(c),
    )
    before = F.when(keyword.rlike("^[A-Za-z0-9_]"), F.lit("(?<![A-Za-z0-9_])")).otherwise(
        F.lit("(?<=[A-Za-z0-9_])")
    )
    after = F.when(keyword.rlike("[A-Za-z0-9_]$"), F.lit("(?![A-Za-z0-9_])")).otherwise(
        F.lit("(?=[A-Za-z0-9_])")
    )
    return F.concat(before, F.array_join(chars, ""), after)


def keyword_pattern(keywords: Column | str) -> Column:
    """Java regular expression matching any keyword as a whole word, ignoring case.

    Word boundaries are spelled out over ASCII, since Java's ``\\b`` counts accented letters as
    word characters. An empty list matches nothing.
    """
    keywords = F.col(keywords) if isinstance(keywords, str) else keywords
    body = F.array_join(F.transform(keywords, _bounded_literal), "|")
    return F.when(F.size(keywords) > 0, F.concat(F.lit("(?i)(?:"), body, F.lit(")"))).otherwise(
        F.lit("(?!)")
    )
