"""Personal data by shape and by bootstrapped context.  DataFrame functions only.

Base spans come from fixed patterns with checks.  They seed the bootstrapping: the words beside them are
lexical patterns, every identifier-like token is an instance, and the two sides of that graph score each other
for a few rounds.  Instances that trusted patterns surround join the spans if their shape fits the kind: by one
of a few fixed shapes, or by a form that the data show to be the kind's, as several instances of it and most of
them stand in trusted contexts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, as_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns, leftmost and non-overlapping.  The possessive forms and the conditions before
# the first character match the same strings as the plain ones; they keep very long runs from being tried anew
# at each of their characters or from taking a stack frame for each.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
DIGITS = r"[0-9]"

#: What an identifier-like token has: a digit or an at sign, which may be spelt out.
MARK = r"(?:[0-9@]|\(at\)|\[at\])"
TOKEN = rf"(?<!\S)(?:[^\s0-9@(\[]++|(?!{MARK})[(\[])*+{MARK}\S*+"
#: Shapes that an instance must have to be taken for a kind on the strength of its context.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9.-]+(?:\.|\(dot\)|\[dot\])[A-Za-z]{2,}$",
    "ip": r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9]{4}(?:[.-][0-9]{4}){3}$",
    "phone": r"^(?:00[0-9]{8,13}|\(?[0-9]{2,4}[).-]+[0-9]{3,4}[.-]?[0-9]{3,4})$",
}

NEAR_CHARS = 40  # where the words beside a match are looked for first, which is quicker than in the whole gap
WORD_CHARS = 64  # longer words are told apart by their md5
ROUNDS = 3
MIN_SUPPORT = 3  # distinct seeds beside a pattern
MIN_TRUST = 0.8  # of a pattern: share of its instances that are of the kind
MIN_SCORE = 0.9  # of an instance: 1 less the product of its patterns' doubts
MIN_FORMS = 3  # distinct instances of a form in trusted contexts of a kind
MIN_FORM_SHARE = 0.5  # of the distinct instances of a form, those in trusted contexts of the kind


def _luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    turned = F.reverse(digits)
    values = F.transform(F.split(turned, ""), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _word(near: Column, whole_word: str, gap: Column, pattern: str) -> Column:
    """The word next to a match: in the near part of the gap, if it lies there whole, else in all of it."""
    return F.coalesce(F.nullif(F.regexp_extract(near, whole_word, 1), F.lit("")), F.regexp_extract(gap, pattern, 1))


def _pattern_word(word: Column) -> Column:
    plain = F.lower(F.regexp_replace(word, DIGITS, "0"))
    return F.when(F.length(plain) > WORD_CHARS, F.concat(F.lit("#"), F.md5(plain))).otherwise(plain)


def form(value: Column) -> Column:
    """What instances of one make have in common: runs of letters, and of digits by length, between what else there is."""
    out = F.regexp_replace(value, r"\p{L}+", "a")
    for digits, mark in (("{5,}", "N"), ("{3,4}", "M"), ("{1,2}", "D")):
        out = F.regexp_replace(out, DIGITS + digits, mark)
    return F.when(F.length(out) > WORD_CHARS, F.concat(F.lit("#"), F.md5(out))).otherwise(out)


def _found(text: Column, name: str, pattern: str, hint: str | None) -> Column:
    """The matches of a pattern with the length of the gap before each and the words beside it."""
    test = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    if name not in ("email", "token"):
        test = test & text.rlike(DIGITS)
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(parts, F.lit(1), F.size(hits)).alias("gap"), F.slice(parts, F.lit(2), F.size(hits)).alias("rest")),
        lambda x, i: F.struct(
            F.lit(name).alias("kind"),
            i.alias("nth"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("len"),
            x["hit"].alias("value"),
            _word(F.right(x["gap"], F.lit(NEAR_CHARS)), r"\s(\S++)\s*+$", x["gap"], r"(?<!\S)(\S++)\s*+$").alias("left"),
            _word(F.left(x["rest"], F.lit(NEAR_CHARS)), r"^\s*+(\S++)\s", x["rest"], r"^\s*+(\S++)").alias("right"),
        ),
    )
    return F.when(test, rows)


def occurrences(keyed: DataFrame) -> DataFrame:
    """Distinct base matches and identifier-like tokens: id, sum, kind, start, end, value, left, right, valid."""
    text = F.col("text")
    found = [_found(text, k, PATTERNS[k], HINTS[k]) for k in KINDS]
    found.append(F.when(text.rlike(MARK), _found(text, "token", TOKEN, None)))
    rows = keyed.select("id", "sum", F.inline(F.flatten(F.array_compact(F.array(*found))))).distinct()
    order = Window.partitionBy("id", "sum", "kind").orderBy("nth")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order))
    valid = reduce(lambda a, k: a.when(F.col("kind") == k, _valid(k, F.col("value"))), KINDS, F.when(F.lit(False), F.lit(True))).otherwise(F.lit(True))
    return rows.select("id", "sum", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value", *[_pattern_word(F.col(c)).alias(c) for c in ("left", "right")], valid.alias("valid"))


def _uncovered(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens that no base span overlaps, by running bounds of the spans before and after each."""
    cover = base.select("id", "sum", "start", F.col("start").alias("from"), F.col("end").alias("upto")).withColumn("token", F.lit(None).cast(tokens.schema["token"].dataType))
    rows = tokens.select("id", "sum", "start", F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("upto"), "token").unionByName(cover)
    place = Window.partitionBy("id", "sum")
    rows = rows.withColumn("reach", F.max("upto").over(place.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.min("from").over(place.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("token is not null")
    return rows.where((F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("token.end")))).select("id", "sum", "token.*")


def discovered(seen: DataFrame, store: Stored, rounds: int = ROUNDS) -> DataFrame:
    """Spans that context adds: id, sum, kind, start, end.

    A pattern is a word on one side of an instance.  A round scores each pattern for each kind by the share
    of its distinct instances that are known to be of that kind, keeps those with enough support and trust, and
    scores each unknown instance by its patterns' doubts.  Of instances above ``MIN_SCORE`` those become known
    whose shape is one of the kind's fixed ones, or whose form is: at least ``MIN_FORMS`` instances of it reach
    that score, or did in earlier rounds, and they are at least ``MIN_FORM_SHARE`` of all that have the form.  An
    instance that fits several kinds takes the best score, and of equal ones the first kind of ``KINDS``.
    Scores are sums by key, which Spark combines before the shuffle; tables that joins read are stored, so
    adaptive execution may split a word that very many instances stand beside.
    """
    base = seen.where("kind <> 'token' and valid")
    tokens = seen.where("kind = 'token'").select("id", "sum", "start", F.struct("start", "end", "value", "left", "right").alias("token"))
    free = _uncovered(tokens, base)
    core = F.regexp_replace("value", r"^[\"'(\[<{]+|[\"')\]>},;:.!?]+$", "")
    lead = F.length(F.regexp_extract("value", r"^[\"'(\[<{]*", 0))
    free = free.select("id", "sum", (F.col("start") + lead).alias("start"), core.alias("value"), "left", "right").withColumn("end", F.col("start") + F.length("value"))
    free = free.where("length(value) > 0").withColumn("shape", reduce(lambda a, k: a.when(F.col("value").rlike(SHAPES[k]), k), KINDS, F.when(F.lit(False), "")))
    free = store.put(free.withColumn("form", form(F.col("value"))), "tokens")
    forms = store.put(free.select("form", "value").distinct().groupBy("form").agg(F.count("*").alias("of")), "forms")

    def patterns(df: DataFrame, *keep: str) -> DataFrame:
        sides = F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word")))
        return df.select(*keep, F.inline(sides)).where("word <> ''")

    graph = store.put(patterns(free, "value", "shape", "form").distinct(), "graph")
    sure = store.put(patterns(base.select("kind", "value", "left", "right"), "kind", "value").distinct(), "seeds")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    known = None
    for _ in range(rounds):
        more = sure if known is None else sure.unionByName(graph.join(known, "value").select("kind", "value", "side", "word")).distinct()
        good = more.groupBy("side", "word", "kind").agg(F.count("*").alias("n"))
        unknown = graph if known is None else graph.join(known, "value", "left_anti")
        total = more.groupBy("side", "word").agg(F.count("*").alias("k")).join(unknown.groupBy("side", "word").agg(F.count("*").alias("u")), ["side", "word"], "left")
        trust = good.join(total, ["side", "word"]).withColumn("trust", F.col("n") / (F.col("k") + F.coalesce("u", F.lit(0))))
        trust = store.put(trust.where((F.col("n") >= MIN_SUPPORT) & (F.col("trust") >= MIN_TRUST)).select("side", "word", "kind", "trust"), "trust")
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(0.01))))
        voted = unknown.join(trust, ["side", "word"]).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"), F.any_value("shape").alias("shape"), F.any_value("form").alias("form"))
        voted = store.put(voted.where(F.col("score") >= MIN_SCORE), "voted")
        same = voted.select("form", "kind") if known is None else voted.select("form", "kind").unionByName(known.select("form", "kind"))
        fit = same.groupBy("form", "kind").agg(F.count("*").alias("here")).join(forms, "form")
        fit = fit.where((F.col("here") >= MIN_FORMS) & (F.col("here") >= MIN_FORM_SHARE * F.col("of"))).select("form", "kind", F.lit(True).alias("fits"))
        fresh = voted.join(store.put(fit, "fit"), ["form", "kind"], "left").where(F.coalesce("fits", F.lit(False)) | F.coalesce(F.col("shape") == F.col("kind"), F.lit(False)))
        fresh = fresh.groupBy("value", "form").agg(F.max(F.struct(F.round("score", 9), -order, "kind")).alias("best")).select("value", "best.kind", "form")
        after = store.put(fresh if known is None else known.unionByName(fresh), "known")
        if known is not None and after.count() == known.count() or known is None and not after.limit(1).count():
            known = after
            break
        known = after
    return free.drop("form").join(known, "value").select("id", "sum", "kind", "start", "end").distinct()


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` by its id and md5 of the text, with counts, base_sha256, and all spans.

    Columns: ``id`` under its own name, n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256 and
    spans: kind:start:end in code points, end exclusive, by kind as in ``KINDS``, then start.

    Null text is empty and has no spans; a very long one is searched whole, and so are the gaps between matches
    for the words beside them.  A null id stays null.  Rows equal in id and text get equal results; no rows give
    no rows; other columns are not read.  A match that fails its check is dropped and not retried.
    """
    store = Stored(docs.sparkSession, "pii")
    value = as_text(docs, text)
    first = F.lit(-(1 << 63))
    keyed = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), first).alias("id"), F.md5(value).alias("sum"), value.alias("text"))
    seen = store.put(occurrences(keyed), "seen")
    base = seen.where("kind <> 'token' and valid").select("id", "sum", "kind", "start", "end", F.lit(True).alias("base"))
    added = discovered(seen, store).withColumn("base", F.lit(False))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = base.unionByName(added).groupBy("id", "sum").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("s"))
    show = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    of = lambda k: F.coalesce(F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == k))), F.lit(0)).cast("long")
    rows = keyed.select("id", "sum").join(spans, ["id", "sum"], "left")
    return rows.select(
        F.when(F.col("id") != first, F.col("id")).alias(id),
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.coalesce(F.size(F.filter("s", lambda x: ~x["base"])), F.lit(0)).cast("long").alias("n_added"),
        F.sha2(F.coalesce(F.array_join(F.transform(F.filter("s", lambda x: x["base"]), show), ","), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.transform("s", show), ","), F.lit("")).alias("spans"),
    )
