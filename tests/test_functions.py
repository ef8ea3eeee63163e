import pytest
from pyspark.sql import functions as F

from sentispark.functions import keywords as K
from sentispark.functions import labels as L
from sentispark.functions import text as X
from sentispark.functions.numeric import round_half_up


@pytest.mark.parametrize(
    "prompt, expected",
    [
        ("bitcoin", ["bitcoin"]),
        ("Bitcoin and Ethereum", ["bitcoin", "ethereum"]),
        ("#crypto #bitcoin trading", ["crypto", "bitcoin", "trading"]),
        ("the and is a to", []),
        ("a to be", []),
        ("#The_Day day x café 5g", ["the_day", "5g"]),
        ("moon shot moon", ["moon", "shot", "moon"]),
        (" ".join(f"word{i}" for i in range(50)), [f"word{i}" for i in range(20)]),
    ],
)
def test_extract_keywords(value, prompt, expected):
    # "_" separates words, so the hashtag the_day also leaves "the" and "day", both stop words.
    assert value(K.extract_keywords("p", 20), p=("string", prompt)) == expected


@pytest.mark.parametrize(
    "words, text, expected",
    [
        (["bitcoin"], "I bought bitcoin", True),
        (["bitcoin"], "BITCOIN is great", True),
        (["coin"], "coin is money", True),
        (["coin"], "bitcoin", False),
        (["coin"], "coins", False),
        (["test.com"], "visit test.com now", True),
        (["test.com"], "visit testXcom", False),
        (["bitcoin"], "my-bitcoin-wallet", True),
        (["caf"], "un café x", True),
        (["café"], "un CAFÉs x", True),
        (["$btc"], "a$btc", True),
        (["$btc"], "a $btc", False),
        (["k"], "300 K", False),
        ([], "anything", False),
    ],
)
def test_keyword_pattern(value, words, text, expected):
    column = F.regexp_like("t", K.keyword_pattern("k"))
    assert value(column, t=("string", text), k=("array<string>", words)) is expected


def test_word_list_keeps_unicode_look_alikes_apart(value):
    assert value(K.word_list("t"), t=("string", "AKB İx, The_end. the")) == ["a", "b", "x", "the_end", "the"]


@pytest.mark.parametrize("x, expected", [(-2.5, -2), (2.5, 3), (-2.6, -3), (0.49, 0)])
def test_round_half_up(value, x, expected):
    assert value(round_half_up(F.col("x")), x=("double", x)) == expected


@pytest.mark.parametrize(
    "score, label", [(-0.11, "negative"), (-0.1, "neutral"), (0.1, "neutral"), (0.11, "positive")]
)
def test_score_label(value, score, label):
    assert value(L.score_label("s"), s=("double", score)) == label


@pytest.mark.parametrize(
    "nss, description, market",
    [
        (50, "Very Positive", "Very Bullish"),
        (20, "Positive", "Bullish"),
        (-20, "Neutral", "Bearish"),
        (-50, "Negative", "Very Bearish"),
        (-51, "Very Negative", "Very Bearish"),
    ],
)
def test_nss_labels(value, nss, description, market):
    n = F.col("n")
    both = F.array(L.nss_description(n), L.nss_market_label(n))
    assert value(both, n=("int", nss)) == [description, market]


@pytest.mark.parametrize(
    "label, p, expected",
    [
        ("POSITIVE", 0.9, (0.9, "positive", 0.9)),
        ("NEGATIVE", 0.9, (-0.9, "negative", 0.9)),
        ("positive", 0.59, (0.59, "neutral", 0.59)),
        ("NEGATIVE", 1.5, (-1.0, "negative", 1.0)),
    ],
)
def test_class_to_sentiment(value, label, p, expected):
    got = value(L.class_to_sentiment(F.col("l"), F.col("p")), l=("string", label), p=("double", p))
    assert tuple(got) == expected


def test_signed_score(value):
    assert value(L.signed_score(F.col("s")), s=("double", 0.75)) == "+0.75"
    assert value(L.signed_score(F.col("s")), s=("double", -0.32)) == "-0.32"
    assert value(L.signed_score(F.col("s")), s=("double", 0.0)) == "0.00"


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://x.org/a", "https://x.org/a"),
        ("//evil.org", ""),
        ("javascript:alert(1)", ""),
        ("java\nscript:alert(1)", ""),
        ("data:text/html,x", ""),
        ("/posts/1", "/posts/1"),
        ("ftp://x.org", ""),
    ],
)
def test_safe_url(value, url, expected):
    assert value(X.safe_url("u"), u=("string", url)) == expected


def test_strip_html(value):
    html = "This is great! <b class='x'>#amazing</b> <script>alert('xss')</script><!-- no -->1 < 2"
    assert value(X.strip_html("h"), h=("string", html)) == "This is great! #amazing 1 < 2"


def test_truncation(value):
    assert value(X.truncate_text("t", 6), t=("string", "hello world")) == "hello..."
    assert value(X.truncate_text("t", 11), t=("string", "hello world")) == "hello world"
    assert value(X.truncate_for_model("t"), t=("string", "x" * 501)) == "x" * 500 + "..."


def test_log_safe(value):
    assert value(X.log_safe("t"), t=("string", "  a\nb\x00\x7fc\t")) == "a bc"


@pytest.mark.parametrize("text, blank", [("", True), ("  \n\t  ", True), ("x", False), (None, True)])
def test_blank(value, text, blank):
    assert value(L.is_blank("t"), t=("string", text)) is blank


@pytest.mark.parametrize(
    "at, expected",
    [
        ("2024-01-19 23:59:30", "just now"),
        ("2024-01-19 23:15:00", "45m ago"),
        ("2024-01-19 02:00:00", "22h ago"),
        ("2024-01-15 00:00:00", "5d ago"),
        ("2023-12-01 00:00:00", "Dec 1, 2023"),
    ],
)
def test_relative_time(value, at, expected):
    as_of = F.lit("2024-01-20").cast("timestamp_ntz")
    column = X.relative_time(F.col("t").cast("timestamp_ntz"), as_of, suffix=True, show_year=True)
    assert value(column, t=("string", at)) == expected


def test_top_class_first_wins_ties(value):
    classes = "array<struct<label string, score double>>"
    got = value(L.top_class(F.col("c")), c=(classes, [("A", 0.5), ("B", 0.5)]))
    assert got["label"] == "A"


def test_retryable(value):
    assert value(X.is_retryable("e"), e=("string", "Connection Timeout")) is True
    assert value(X.is_retryable("e"), e=("string", "ENOTFOUND")) is False
    assert value(X.is_retryable("e", X.EVENT_RETRY_WORDS), e=("string", "ENOTFOUND")) is True
    assert value(X.is_retryable("e"), e=("string", None)) is False
