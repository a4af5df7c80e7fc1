"""Scalar text functions as Columns.  ``as_of`` is always a parameter: nothing reads the clock."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

#: The same characters one by one, for functions that take a set.
WHITE_SET = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"

# Words that don't count as query terms.
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "have", "what", "when", "where", "which", "about",
    "into", "your", "just", "like", "want", "need", "does", "will", "would", "could", "should", "been",
)


def normalize(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE, " "))


def capital_letter(letter: Column) -> Column:
    """The capital of one letter, always one letter: ß gives ẞ (not SS), and one that has only a capital of several letters (ŉ, ﬁ) stays."""
    whole, first = F.upper(letter), F.initcap(letter)
    single = F.when(letter == "ß", "ẞ").when(F.length(first) == 1, first).otherwise(letter)
    return F.when(F.length(whole) > 1, single).otherwise(whole)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` names it and wherever the expression ends up (a filter or a generator
    computes a named column anew for each mention)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_runs(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """Whole words of three or more characters a-z and 0-9, with repeats."""
    return F.filter(word_runs(text), lambda w: w.rlike("^[a-z0-9]{3,}$"))


def token_set(text: Column) -> Column:
    return F.array_distinct(query_words(text))


def query_terms(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(query_words(text), lambda w: ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def response_words(text: Column) -> Column:
    """Distinct words of a reply: punctuation is white space."""
    return F.array_distinct(word_runs(text))


def contains_any(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def starts_any(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(m)) for m in markers])


def parse_timestamp(text: Column) -> Column:
    """Epoch number, hyphenated or ISO 8601 text to a UTC timestamp; null if none fits."""
    t = F.trim(text)
    epoch = F.when(t.rlike(r"^[0-9]+\.?[0-9]*$"), F.timestamp_micros((t.try_cast("decimal(38,6)") * 1_000_000).cast("long")))
    parts = r"^(\d{4}-\d{2}-\d{2}T\d{2})-(\d{2})-(\d{2})(?:-(\d{1,6}))?$"
    hyphens = F.regexp_replace(F.regexp_replace(t, parts, "$1:$2:$3.$4"), r"\.$", "")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), t.try_cast("timestamp"))
    return F.coalesce(epoch, F.when(t.rlike(parts), hyphens.try_cast("timestamp")), iso)


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days between two moments, 0 at least."""
    seconds = F.unix_micros(as_of) - F.unix_micros(ts)
    return F.greatest(F.floor(seconds / 86_400_000_000), F.lit(0)).cast("long")


def recency_bucket(days: Column) -> Column:
    return (
        F.when(days.isNull(), "unparsed").when(days <= 7, "d7").when(days <= 30, "d30")
        .when(days <= 90, "d90").when(days <= 365, "d365").otherwise("older")
    )


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))


def elapsed_phrase(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    rest = F.floor((seconds % 3600) / 60)
    return (
        F.when(seconds.isNull(), "just now").when(seconds < 60, "less than a minute ago")
        .when(seconds < 3600, F.concat(_counted(minutes, "minute"), F.lit(" ago")))
        .when(rest == 0, F.concat(_counted(hours, "hour"), F.lit(" ago")))
        .otherwise(F.concat(_counted(hours, "hour"), F.lit(" "), _counted(rest, "minute"), F.lit(" ago")))
    )


def relative_age(seconds: Column) -> Column:
    """Minutes, hours, days, months or years ago; ``unknown`` for null."""
    s = F.greatest(seconds, F.lit(0))

    def ago(size: int, unit: str, least: int = 0) -> Column:
        return F.concat(_counted(F.greatest(F.floor(s / size), F.lit(least)), unit), F.lit(" ago"))

    return (
        F.when(seconds.isNull(), "unknown").when(s < 3600, ago(60, "minute", 1)).when(s < 86400, ago(3600, "hour"))
        .when(s < 86400 * 30, ago(86400, "day")).when(s < 86400 * 365, ago(86400 * 30, "month")).otherwise(ago(86400 * 365, "year"))
    )


def record_age(seconds: Column) -> Column:
    minutes, hours, days, weeks = (F.floor(seconds / k) for k in (60, 3600, 86400, 604800))
    return (
        F.when(seconds < 300, "moments ago").when(seconds < 3600, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(seconds < 86400, F.concat(_counted(hours, "hour"), F.lit(" ago"))).when(seconds < 172800, "yesterday")
        .when(seconds < 604800, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(_counted(weeks, "week"), F.lit(" ago")))
    )


def item_date(ts: Column, as_of: Column) -> Column:
    return F.when(age_days(ts, as_of) > 365, F.date_format(ts, "MMM dd, yyyy")).otherwise(F.date_format(ts, "MMM dd"))


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(text, WHITE, " ")), " "), lambda w: w != ""))
    return F.floor(words * F.lit(13) / 10).cast("long")


def coerce_version(raw: Column) -> Column:
    """A version as an integer: digits, or a number without a fraction; all else is 0."""
    t = F.trim(raw)
    return F.coalesce(F.when(t.rlike(r"^[0-9]{1,18}(\.0+)?$"), F.regexp_replace(t, r"\.0+$", "").try_cast("long")), F.lit(0))


def mentions_third_party(text: Column) -> Column:
    # Kinship words, and verbs of reported speech.
    kin = (
        "mom|dad|mother|father|parent|parents|partner|wife|husband|spouse|girlfriend|boyfriend|ex|sister|brother|"
        "sibling|siblings|son|daughter|kid|kids|child|children|friend|friends|bestie|best\\s+friend|boss|coworker|"
        "coworkers|colleague|colleagues|manager|teammate|therapist|doctor|teacher|professor|advisor|mentor|coach|"
        "roommate|neighbor"
    )
    common = "said|told|asked|thinks?|thought|feels?|felt|wants?|wanted|believes?|believed|did|does|mentioned"
    pronoun = common + "|knows?|knew|replied|answered|claimed|insisted|admitted|agreed|disagreed"
    edge, after = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    low = F.lower(text)
    return F.coalesce(
        low.rlike(rf"{edge}my\s+(?:{kin}){after}")
        | low.rlike(rf"{edge}(?:she|he|they)\s+(?:{pronoun}){after}")
        | text.rlike(rf"{edge}[A-Z][a-z]+\s+(?:{common}){after}"),
        F.lit(False),
    )


def conversation_title(text: Column, default: str = "New conversation", limit: int = 50) -> Column:
    head = F.trim(F.substring(text, 1, limit))
    cut = F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("..."))
    return F.when(F.coalesce(head, F.lit("")) == "", default).when((F.length(text) > limit) & F.contains(head, F.lit(" ")), cut).otherwise(head)


def canonical_url(url: Column) -> tuple[Column, Column]:
    """Host without ``www.`` and path without its last slash, both lower-cased."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero-norm or unequal lengths; sums in double."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms), F.lit(0.0))


def halved(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -days / half_life)
