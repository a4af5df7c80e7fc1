"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers;
these are the seeds.  They, and every other token with a digit or an @, are instances (neighbouring
groups of digits are one, as in ``(415) 555-2671``); the words to
their left (and a ``key=`` or ``key:`` within) are their lexical patterns.  Patterns and
instances score each other over their graph: a pattern by the mean score of its distinct
instances, an instance by its best pattern.  Patterns that end up trusted, with enough
distinct seeds, turn the identifiers in their context into spans of the kind of
most of their seeds.

Spans are code point offsets.  ``split`` and ``regexp_extract_all`` with the same
pattern give the text between the matches and the matches, whose lengths add up to the
offsets.  The patterns have possessive quantifiers and begin where a run
begins, which finds the same matches in linear time on any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the contract's patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a text can't have a span of the kind.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\."),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What may lie between the groups of a number, tokens after which one may go on, and tokens that go on.
GAP = r"^[\h().\[\]-]++$"
FIRST_GROUP = r"^(?:[^\s=:0-9@]++[=:])?[+().\[\]-]*+[0-9][0-9().\[\]-]*+$"
NEXT_GROUP = r"^[().\[\]-]*+[0-9][0-9().\[\]-]*+(?:[xX#][0-9]++)?+(?:[^\s0-9A-Za-z@][^\s@]*+)?+$"
#: A token with as many digits as the shortest phone number ends its number.
WHOLE_DIGITS = 9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            value = F.concat(F.lit("0"), F.regexp_replace(part, "^0+", ""))
            return (F.length(value) <= 4) & (value.try_cast("int") <= 255)

        return F.forall(F.split(m, r"\."), small)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


#: Items of a scan that are gone through together, and characters before a match that are kept as its context.
TOGETHER, CONTEXT = 64, 80


def _scan(items: Column, zero: Column, move, emit, element: str) -> Column:
    """emit(state, item) for each item; the state begins with ``zero`` and becomes move(state, item).

    A fold that appends to an array copies it each time.  So runs of TOGETHER items are folded, each from
    the state before it; the arrays that grow stay short, and the time is about linear in the items.
    """

    def states(runs: Column) -> Column:
        first = F.struct(zero.alias("s"), F.slice(F.array(zero), 1, 0).alias("out"))

        def after(acc: Column, run: Column) -> Column:
            return F.struct(F.aggregate(run, acc["s"], move).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))

        return F.aggregate(runs, first, after, lambda acc: acc["out"])

    def emitted(run: Column, state: Column) -> Column:
        none = F.array().cast(f"array<{element}>")

        def step(acc: Column, x: Column) -> Column:
            return F.struct(move(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))

        return F.aggregate(run, F.struct(state.alias("s"), none.alias("out")), step, lambda acc: acc["out"])

    def places(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / TOGETHER).cast("int")
        return F.when(F.size(xs) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    runs = _let(items, lambda xs: F.transform(places(xs), lambda c: F.slice(xs, c * TOGETHER + 1, TOGETHER)))
    return _let(runs, lambda rs: F.flatten(F.zip_with(rs, states(rs), emitted)))


def _located(text: Column, pattern: str, make, element: str) -> Column:
    """make(match, text since the match before, up to CONTEXT characters before it, start, end) for each match."""

    def tail(before: Column, more: Column) -> Column:
        return F.right(F.concat(before, F.right(more, F.lit(CONTEXT))), F.lit(CONTEXT))

    def move(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["p"]) + F.length(x["m"])
        return F.struct(at.alias("at"), tail(state["tail"], F.concat(F.right(x["p"], F.lit(CONTEXT)), x["m"])).alias("tail"))

    def emit(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["p"])
        return make(x["m"], x["p"], tail(state["tail"], x["p"]), begin, begin + F.length(x["m"]))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    return _scan(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), move, emit, element)


_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = "struct<start:int,kind:int,end:int,before:string,token:string>"


def _base_spans(text: Column, kind: str) -> Column:
    number = KINDS.index(kind)

    def make(m, since, before, begin, end):
        return F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"), before.alias("before"), m.alias("token"))

    found = F.filter(_located(text, PATTERNS[kind], make, _FOUND), lambda s: _valid(kind, s["token"]))
    return F.when(GUARDS[kind](text), found).otherwise(F.array().cast(f"array<{_FOUND}>"))


_TOKEN = "struct<start:int,end:int,token:string,since:string,before:string>"


def _instance(begin: Column, end: Column, token: Column, before: Column, seed: Column) -> Column:
    """``before`` is text that ends where the instance begins; its last two words are the context."""
    near = F.split(F.trim(F.regexp_replace(F.lower(before), r"\s+", " ")), " ")
    left = _let(near, lambda words: F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " "))
    return F.struct(begin.alias("start"), end.alias("end"), token.alias("token"), left.alias("left"), seed.cast("int").alias("seed"))


def _seeds(base: Column) -> Column:
    return F.transform(base, lambda s: _instance(s["start"], s["end"], s["token"], s["before"], s["kind"]))


def _tokens(text: Column) -> Column:
    """Tokens with a digit or @, the text since the token before, and that before the token."""

    def make(m, since, before, begin, end):
        return F.struct(begin.alias("start"), end.alias("end"), m.alias("token"), since.alias("since"), before.alias("before"))

    found = _located(text, TOKEN, make, _TOKEN)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(f"array<{_TOKEN}>"))


def _with_contexts(tokens: Column) -> Column:
    """Each token as an instance, whether it goes on with the number before it, and the text since that."""

    def told(t: Column, i: Column) -> Column:
        last = F.get(tokens, i - 1)
        follows = (i > 0) & t["since"].rlike(GAP) & t["token"].rlike(NEXT_GROUP) & last["token"].rlike(FIRST_GROUP)
        follows = follows & (F.length(_digits(last["token"])) < WHOLE_DIGITS)
        instance = _instance(t["start"], t["end"], t["token"], t["before"], F.lit(None))
        return F.struct(instance.alias("t"), F.coalesce(follows, F.lit(False)).alias("follows"), t["since"].alias("before"))

    return F.transform(tokens, told)


def _joined(tokens: Column, first: Column) -> Column:
    """Instances: neighbouring groups of digits are one, so a number written in groups is seen whole.

    ``first`` has the places (from 1) of ``tokens`` that don't go on with a number.
    """

    def run(at: Column, j: Column) -> Column:
        t = F.get(tokens, at - 1)["t"]
        n = F.coalesce(F.get(first, j + 1), F.size(tokens) + 1) - at
        rest = F.transform(F.slice(tokens, at + 1, n - 1), lambda x: F.concat(x["before"], x["t"]["token"]))
        return F.struct(
            t["start"].alias("start"),
            F.get(tokens, at + n - 2)["t"]["end"].alias("end"),
            F.concat(t["token"], F.array_join(rest, "")).alias("token"),
            t["left"].alias("left"),
            t["seed"].alias("seed"),
        )

    return F.transform(first, run)


def _hit(tokens: Column, base: Column) -> Column:
    """Whether each token overlaps a base span: some span that begins before its end ends beyond its start."""
    ends = F.transform(tokens, lambda x: F.struct(x["t"]["end"].alias("key"), F.lit(0).alias("which"), x["t"]["start"].alias("at")))
    starts = F.transform(base, lambda s: F.struct(s["start"].alias("key"), F.lit(1).alias("which"), s["end"].alias("at")))
    told = _scan(
        F.array_sort(F.concat(ends, starts)),
        F.lit(-1),
        lambda far, x: F.when(x["which"] == 1, F.greatest(far, x["at"])).otherwise(far),
        lambda far, x: F.struct(x["which"].alias("which"), (far > x["at"]).alias("hit")),
        "struct<which:int,hit:boolean>",
    )
    return F.transform(F.filter(told, lambda x: x["which"] == 0), lambda x: x["hit"])


def _instances(rows: DataFrame) -> DataFrame:
    """``rows`` with the seeds and the other instances of ``_text``; each array is a column, so that it is made once."""
    rows = rows.withColumn("tokens", _tokens(F.col("_text")))
    rows = rows.withColumn("tokens", _with_contexts(F.col("tokens")))
    # a base span parts the groups on both sides of it
    rows = rows.withColumn("hit", F.when(F.size("base") > 0, _hit(F.col("tokens"), F.col("base"))).otherwise(F.transform("tokens", lambda x: F.lit(False))))
    kept = F.filter(F.transform("tokens", lambda x, i: F.struct(
        x["t"].alias("t"), (x["follows"] & ~F.get("hit", i - 1)).alias("follows"), x["before"].alias("before"), F.get("hit", i).alias("hit"))
    ), lambda x: ~x["hit"])
    rows = rows.withColumn("tokens", kept).drop("hit")
    places = F.transform("tokens", lambda x, i: F.when(~F.coalesce(x["follows"], F.lit(False)), i + 1))
    rows = rows.withColumn("first", F.filter(places, lambda i: i.isNotNull()))
    joined = _joined(F.col("tokens"), F.col("first"))
    return rows.withColumn("instances", F.concat(_seeds(F.col("base")), joined)).drop("tokens", "first", "_text")


def _contexts(instances: DataFrame) -> DataFrame:
    """A row for each instance and pattern: the word before, the two before, and a key within the token."""
    last = F.element_at(F.split("left", " "), -1)
    key = F.lower(F.regexp_extract("token", r"^([^\s=:0-9@]{2,40}[=:])", 1))
    patterns = F.array_distinct(F.array(last, F.col("left"), key))
    return instances.withColumn("pattern", F.explode(F.filter(patterns, lambda p: F.length(p) > 0)))


def trusted_patterns(instances: DataFrame, rounds: int, confidence: float, least_seeds: int) -> tuple[DataFrame, DataFrame]:
    """pattern and kind of the patterns that the graph comes to trust; and the hot patterns.

    ``instances`` has token, left and seed (the kind, or null).  Hot patterns and tokens, with
    more than a thousandth of the edges or instances each, are broadcast where the others are shuffled.
    """
    edges = _contexts(instances.select("token", "left", "seed"))
    edges = materialize(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "edges")
    total, many = edges.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def hot(side: str) -> DataFrame:
        sums = edges.groupBy(side).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        return materialize(sums.where((F.col("k") * 1000 > total) | (F.col("n") * 1000 > many)).select(side), f"hot-{side}")

    hot_patterns, hot_tokens = hot("pattern"), hot("token")
    scores = edges.groupBy("token").agg(F.when(F.max("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))

    def weighed(scores: DataFrame) -> DataFrame:
        # one unseen instance more than there are, so a pattern with few is trusted less
        trust = (F.sum("score") / (F.count("*") + 1)).alias("trust")
        told = join_hot(edges, scores, "token", hot_tokens).groupBy("pattern")
        return told.agg(trust, F.count("seed").alias("seeds"), F.mode("seed", True).alias("kind"))

    for _ in range(rounds):
        trust = weighed(scores).select("pattern", "trust")
        best = join_hot(edges, trust, "pattern", hot_patterns).groupBy("token").agg(F.max("seed").alias("seed"), F.max("trust").alias("best"))
        scores = materialize(best.select("token", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("best")).alias("score")), "scores")
    told = weighed(scores).where((F.col("trust") >= confidence) & (F.col("seeds") >= least_seeds))
    return told.select("pattern", "kind"), hot_patterns


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_personal_data(
    docs: DataFrame, rounds: int = 3, confidence: float = 0.75, least_seeds: int = 5, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) of every document, and the columns in ``keep``.

    Null texts are empty and have no spans.  ``base`` holds the base patterns'
    valid matches, leftmost and non-overlapping in each kind; ``spans`` adds what
    trusted patterns discover (instances with an @ or six digits that overlap no base span).  Both
    are ordered by start, then kind.  Repeated rows, and rows with null or equal
    ids, are rows of their own; an empty table gives an empty result.  Texts of any length are scanned whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[_base_spans(text, k) for k in KINDS]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("_text"), base.alias("base"))
    rows = _instances(rows)
    rows = rows.withColumn("base", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    exploded = rows.select("row", F.explode("instances").alias("t")).select("row", "t.*")
    trusted, hot = trusted_patterns(exploded, rounds, confidence, least_seeds)

    whole = F.contains("token", F.lit("@")) | (F.length(_digits(F.col("token"))) >= 6)
    unseen = _contexts(exploded.where(F.col("seed").isNull() & whole))
    span = F.struct("start", "kind", "end")
    found = join_hot(unseen, materialize(trusted, "trusted"), "pattern", hot).groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    found = found.groupBy("row").agg(F.collect_list(span.cast(_SPAN)).alias("found"))
    both = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(f"array<{_SPAN}>"))))
    return rows.join(found, "row", "left").select("doc_id", *keep, "base", both.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and listings of ``find_personal_data``'s spans."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


#: Characters of a text in which its spans are replaced at once.
PIECE = 1 << 15


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one.

    It is cut into pieces, and every piece sees the spans that reach into it: a span's mark is written where it
    starts.  So no fold copies more than a piece.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def cleaned(piece: Column, i: Column) -> Column:
        begin = i * PIECE
        end = begin + F.length(piece)
        start = F.struct(begin.cast("int").alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            before = F.substring(piece, acc["at"] - begin + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            mark = F.when((s["start"] >= acc["at"]) & (s["start"] >= begin), F.element_at(names, s["kind"] + 1)).otherwise("")
            return F.struct(F.greatest(acc["at"], F.least(s["end"], end)).alias("at"), F.concat(acc["out"], before, mark).alias("out"))

        inside = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > begin))
        return F.aggregate(inside, start, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] - begin + 1, F.length(piece))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.array_join(F.transform(pieces, cleaned), "")


def redact_documents(docs: DataFrame) -> DataFrame:
    """All documents and columns, with the personal data in ``text`` replaced and ``n_chars`` (if there) set anew.

    Null texts stay null, texts without personal data stay as they are; repeated rows are rows of
    their own.  Extra columns may have any names.  An empty table gives an empty result.
    """
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    found = find_personal_data(packed, keep=("_row",))
    text = F.col("_row.text")
    redacted = F.when(F.size("spans") > 0, redact(text, F.col("spans"))).otherwise(text)
    out = []
    for c in names:
        if c == "text":
            out.append(redacted.alias(c))
        elif c == "n_chars":
            out.append(F.length(redacted).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("_row").getField(c).alias(c))
    return found.select(*out)
