"""Personal data by candidate spans and gradient-boosted trees. Built-in functions only.

Exact rules give the base spans, which always stay. High-recall generators propose
further, overlapping spans. The trees learn from the base spans, from the same spans in
other notations (:func:`_made`), and from documented negatives; a proposal outside the
base that breaks no rule is unlabelled, neither trained nor calibrated on. A threshold
for each kind, calibrated on rows that the trees did not see, decides which proposals
join the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import small, table, text_key, unused, written

KINDS = ("email", "ip", "card", "phone")
_SPAN = "array<struct<start:long,kind:int,end:long,text:string>>"
_NEAR = "array<struct<start:long,end:long,text:string,before:string,after:string>>"
_CUT = "\x01"
#: Documents with accepted proposals that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_DOCS = 200_000

# The generators' patterns (Java syntax, no repeated groups, so that a long
# run costs no stack), in the order of KINDS.
_DOT_ON = r"(?: ?[(\[]dot[)\]] ?[A-Za-z0-9.-]++)?"
_IP_DOT = r" ?(?:[.,]|\[\.\]|\(dot\)|\[dot\]| ) ?"
GENERATORS = (
    r"[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z][A-Za-z0-9.-]*+" + 3 * _DOT_ON,
    rf"(?<![0-9.])[0-9]{{1,3}}{_IP_DOT}[0-9]{{1,3}}{_IP_DOT}[0-9]{{1,3}}{_IP_DOT}[0-9]{{1,3}}(?![0-9])",
    r"(?<![0-9])[0-9][0-9 ./-]{11,30}[0-9](?![0-9])",
    r"(?<![0-9+])\+?\(?[0-9][0-9 ().+/-]{6,22}[0-9](?![0-9])",
)
CONTEXT = (r"(?i)mail|contact|write|courriel|correo", r"(?i)\bip\b|host|server|address", r"(?i)card|visa|credit|karte|carte|tarjeta", r"(?i)call|phone|tel|mobile|fax|anruf")


#: Rows that are made of a base span, at most about.
MADE = 16
#: Code points of a text that are redacted at a time.
_BLOCK = 16_384
#: Elements that a running total is added up over at a time.
_STEP = 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(values: Column, fold, first: Column) -> Column:
    """One value for each run of ``_STEP`` values."""
    return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / _STEP).cast("int")), lambda k: F.aggregate(F.slice(values, k * _STEP + 1, F.lit(_STEP)), first, fold))


def _before(values: Column, fold, first: Column, use) -> Column:
    """``use`` of a function from an index to the fold of all values before it.

    A fold that gathered an array would copy it at each step, so totals are looked up in
    three levels of runs: the work is a hundred small steps a value, however many there are.
    """

    def with_levels(runs: Column, tops: Column) -> Column:
        def at(i: Column) -> Column:
            run, top = (i / _STEP).cast("int"), (i / (_STEP * _STEP)).cast("int")
            total = F.aggregate(F.slice(values, run * _STEP + 1, i - run * _STEP), F.get(tops, top), fold)
            return F.aggregate(F.slice(runs, top * _STEP + 1, run - top * _STEP), total, fold)

        return use(at)

    starts = lambda tops: F.transform(tops, lambda _, i: F.aggregate(F.slice(tops, F.lit(1), i), first, fold))
    return _let(_folded(values, fold, first), lambda runs: _let(_folded(runs, fold, first), lambda tops: _let(starts(tops), lambda above: with_levels(runs, above))))


def _found(text: Column, pattern: str, context: bool = False) -> Column:
    """Array of (start, end, text) of a pattern's matches: cut the text at their edges and add up lengths.

    With ``context``, also ``before`` (20 code points at most, from the four parts before)
    and ``after`` (3). They come from the parts, since each look into a long text counts
    through it from its beginning.
    """
    kind = _NEAR if context else "array<struct<start:long,end:long,text:string>>"

    def spans(parts: Column) -> Column:
        def placed(lengths: Column) -> Column:
            part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
            before = lambda i: F.right(F.concat(*(F.right(part(i - n), F.lit(20)) for n in (4, 3, 2, 1))), F.lit(20)).alias("before")
            after = lambda i: F.left(F.concat(*(F.left(part(i + n), F.lit(3)) for n in (1, 2))), F.lit(3)).alias("after")
            near = lambda i: [before(i), after(i)] if context else []
            span = lambda at, i: _let(at(i), lambda a: F.struct(a.alias("start"), (a + F.get(lengths, i)).alias("end"), F.get(parts, i).alias("text"), *near(i)))
            hits = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
            return _before(lengths, lambda x, y: x + y, F.lit(0).cast("long"), lambda at: F.transform(hits, lambda i: span(at, i)))

        some = _let(F.transform(parts, lambda p: F.length(p).cast("long")), placed)
        return F.when(F.size(parts) > 1, some.cast(kind)).otherwise(F.array().cast(kind))

    return _let(F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1), spans)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(value(i))).otherwise(value(i)))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> list[Column]:
    """For each kind, the spans of its exact rule that pass its test; positions are code points.

    The marks that cut a text are taken out of it first; they belong to no pattern. A dot
    that cannot lie in a domain, and a separator that is not between digits, is marked
    before, so that plain runs of characters match what repeated groups would.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "\x04\x04\x04")
    none = F.array().cast("array<struct<start:long,end:long,text:string>>")
    dots = F.regexp_replace(plain, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "\x02")
    local = r"[A-Za-z0-9._%+\x02-]"
    email = _found(dots, rf"(?:(?<!{local})|\G){local}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++")
    email = F.transform(email, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.translate(s["text"], "\x02", ".").alias("text")))
    octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"  # nothing is left of a zero
    ip = _found(plain, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    ip = F.filter(ip, lambda s: s["text"].rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}\z"))
    gaps = F.regexp_replace(plain, r"(?<![0-9])[ -]|[ -](?![0-9])", "\x03")
    card = F.filter(_found(gaps, r"[0-9][0-9 -]*[0-9]"), lambda s: F.length(_digits(s["text"])).between(14, 19) & luhn(F.substr(_digits(s["text"]), F.lit(1), F.lit(19))))
    phone = F.filter(_found(plain, r"\+[0-9][ ().0-9-]+[0-9]"), lambda s: F.length(_digits(s["text"])).between(10, 15))
    some = F.coalesce(text, F.lit(""))
    return [
        F.when(F.instr(some, "@") > 0, email).otherwise(none),
        F.when(some.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none),
        F.when(some.rlike("[0-9][0-9 -]{12}"), card).otherwise(none),
        F.when(some.rlike(r"\+[0-9]"), phone).otherwise(none),
    ]


def _of_kinds(found: list[Column]) -> Column:
    """Spans of all kinds, by start, then kind, then end."""

    def tag(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), F.lit(kind).alias("kind"), s["end"].cast("long").alias("end"), s["text"].alias("text")))

    tagged = [tag(f, k) for k, f in enumerate(found)]
    return F.sort_array(F.concat(*tagged)).cast(_SPAN)


def proposals(text: Column) -> Column:
    """(c, before, after) of what the generators find: a span, and the text around it."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "\x04\x04\x04")
    none = F.array().cast(_NEAR)
    has = (plain.rlike(r"@|\(at\)|\[at\]"), plain.rlike(r"[0-9] ?[., \[(]"), plain.rlike(r"[0-9][0-9 ./-]{11}"), plain.rlike(r"[0-9][0-9 ().+/-]{6}"))
    found = [F.when(h, _found(plain, g, context=True)).otherwise(none) for h, g in zip(has, GENERATORS, strict=True)]
    span = lambda s, k: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["text"].alias("text")).alias("c")
    tag = lambda k: lambda s: F.struct(span(s, k), s["before"], s["after"])
    return F.sort_array(F.concat(*(F.transform(f, tag(k)) for k, f in enumerate(found))))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _celled(rows: DataFrame, span: str) -> DataFrame:
    """A row for each cell of 256 code points that a span lies in, so that spans meet only those near them."""
    return rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(span)["start"] / 256), F.floor((F.col(span)["end"] - 1) / 256))))


def _features(row: DataFrame) -> DataFrame:
    """Numbers of format and context for each proposed span."""
    t, digits = F.col("c.text"), _digits(F.col("c.text"))
    count = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    numbers = [
        F.length(t), F.length(digits), count("[A-Za-z]"), count("[.]"), count(" "), count("-"), count("[()]"), count("/"),
        t.startswith("+").cast("int"), F.instr(t, "@").cast("int").cast("boolean").cast("int"), luhn(digits).cast("int"),
        F.size(F.array_distinct(F.split(digits, ""))), F.size(F.regexp_extract_all(t, F.lit(r"[0-9]+"), 0)),
        F.coalesce(F.length(F.regexp_extract(t, r"[0-9]+", 0)), F.lit(0)), F.length(F.regexp_extract(t, r"([A-Za-z]*)$", 1)),
        F.greatest(F.lit(0), F.aggregate(F.regexp_extract_all(t, F.lit(r"[0-9]+"), 0), F.lit(0), lambda m, x: F.greatest(m, F.coalesce(F.expr("0") + F.length(x), F.lit(0))))),
        F.aggregate(F.regexp_extract_all(t, F.lit(r"[0-9]+"), 0), F.lit(0), lambda m, x: m + F.when((F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255), 1).otherwise(0)),
        F.col("before").rlike(r"[A-Za-z0-9]$").cast("int"), F.col("after").rlike(r"^[A-Za-z0-9]").cast("int"),
        count(","), t.rlike(r"[.] ").cast("int"), t.rlike(r"[(\[](?:at|dot|\.)[)\]]").cast("int"), t.rlike("^[0-9(]*[0-9]{4}").cast("int"),
        *(F.col("before").rlike(p).cast("int") for p in CONTEXT),
        *((F.col("c.kind") == k).cast("int") for k in range(len(KINDS))),
    ]
    return row.withColumn("numbers", F.array(*(n.cast("double") for n in numbers)))


def _broken() -> Column:
    """Documented negatives: a proposal that is no personal data in any notation.

    A number that goes on in letters or digits (part of a token); an email whose last
    part is no domain, or that runs into the next sentence; an ip with a part over 255,
    or a list of numbers; a card of other than 13 to 19 digits, or against Luhn's test; a
    phone number of other than 7 to 15 digits, a plain run of digits, a date, a decimal,
    a range of years, or a count in groups of three.
    """
    t, kind, digits = F.col("c.text"), F.col("c.kind"), _digits(F.col("c.text"))
    part = F.col("before").rlike(r"[A-Za-z0-9_]\z") | F.col("after").rlike(r"^[A-Za-z0-9_]")
    email = ~t.rlike(r"(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}[.-]?\z") | t.rlike(r"\. [A-Z]")
    ip = t.rlike(r"[0-9] ?,|[0-9] [0-9]") | F.exists(F.regexp_extract_all(t, F.lit("[0-9]+"), 0), lambda x: x.cast("int") > 255)
    card = ~F.length(digits).between(13, 19) | ~luhn(F.substr(digits, F.lit(1), F.lit(19)))
    number = t.rlike(r"^[0-9]+\z|^[0-9]+\.[0-9]+\z|^[0-9]{1,3}(?: [0-9]{3})+\z")
    date = t.rlike(r"^(?:19|20)[0-9]{2}(?: ?[-/] ?(?:19|20)[0-9]{2}\z|[./ -][0-9]{1,2}[./ -][0-9]{1,2}(?![0-9]))|^[0-9]{1,2}[./ -][0-9]{1,2}[./ -](?:19|20)[0-9]{2}(?![0-9])")
    phone = ~F.length(digits).between(7, 15) | number | date
    return F.when(kind == 0, email).when(kind == 1, part | ip).when(kind == 2, part | card).otherwise(part | phone)


def _made(kind: int) -> Column:
    """Array of (text, label) made from a base span ``t`` of a kind, with digits ``d``: other notations of it (1), and what only looks like it (0)."""
    t, digits = F.col("t"), F.col("d")
    name, host = F.split_part(t, F.lit("@"), F.lit(1)), F.split_part(t, F.lit("@"), F.lit(2))
    put = lambda text, old, new: F.replace(text, F.lit(old), F.lit(new))
    cut = lambda a, n: F.substr(digits, F.lit(a), F.lit(n))
    four = lambda d, mark: F.concat_ws(mark, *(F.substr(d, F.lit(a), F.lit(n)) for a, n in ((1, 4), (5, 4), (9, 4), (13, 7))))
    local = F.substr(digits, F.length(digits) - 9, F.lit(10))  # the last ten digits
    at = lambda a, n: F.substr(local, F.lit(a), F.lit(n))
    wrong = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((F.substr(digits, F.length(digits), F.lit(1)).cast("int") + 1) % 10).cast("string"))
    good = (
        [F.concat(name, F.lit(a), put(host, ".", d)) for a, d in (("(at)", "."), (" (at) ", "."), ("[at]", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", "."))],
        [put(t, ".", d) for d in ("[.]", "(dot)", "[dot]", " (dot) ", " . ")],
        [four(digits, mark) for mark in ("/", ".", " - ")],
        [F.regexp_replace(t, r"^\+", ""), F.concat(F.lit("("), at(1, 3), F.lit(") "), at(4, 3), F.lit("-"), at(7, 4)), *(F.concat_ws(m, at(1, 3), at(4, 3), at(7, 4)) for m in ("-", ".", "/")), F.concat(at(1, 3), F.lit(" "), at(4, 3), F.lit("-"), at(7, 4)), F.concat(F.lit("0"), at(1, 2), F.lit(" "), at(3, 4), F.lit(" "), at(7, 4))],
    )
    first = F.split_part(host, F.lit("."), F.lit(1))
    bad = (
        [F.concat(name, F.lit(a), first, F.lit(z)) for a, z in (("@", ". The"), (" @ ", ". In"), ("(at)", ". We"), (" (at) ", ". A"))],
        [put(t, ".", d) for d in (", ", " ", ",")] + [F.regexp_replace(put(t, ".", d), r"^[0-9]+", "777") for d in ("[.]", "(dot)", " . ")] + [F.regexp_replace(put(t, ".", d), r"[0-9]+$", "999") for d in ("[.]", "(dot)", ".")],
        [wrong, *(four(wrong, mark) for mark in ("/", ".", " - ", " "))],
        [digits, cut(1, 8), *(F.concat_ws(m, F.concat(F.lit("20"), cut(1, 2)), F.concat(F.lit("0"), cut(3, 1)), F.concat(F.lit("1"), cut(4, 1))) for m in ("-", "/", ".")), *(F.concat_ws(m, F.concat(F.lit("1"), cut(3, 1)), F.concat(F.lit("0"), cut(4, 1)), F.concat(F.lit("19"), cut(5, 2))) for m in ("-", "/", ".")), F.concat_ws(".", cut(1, 5), cut(6, 4)), F.concat_ws(" ", cut(1, 3), cut(4, 3), cut(7, 3)), F.concat(F.lit("19"), cut(1, 2), F.lit("-20"), cut(3, 2))],
    )
    row = lambda text, label: F.struct(text.alias("text"), F.lit(label).alias("label"))
    return F.array(*(row(x, 1.0) for x in good[kind]), *(row(x, 0.0) for x in bad[kind]))


def _limit(bins: list[tuple[bool, int, int, float]], precision: float, weight: float = 20.0) -> float | None:
    """The lowest score down to which ``precision`` of a kind's calibration rows are personal data; None if there is none.

    bins: (of this kind, score in fiftieths, rows, personal data among them). A kind's share
    is drawn to that of all kinds together, which count as ``weight`` rows of its own; so a
    kind with few rows, or none, goes by all kinds, and none needs a least number of rows.
    """
    own = all_ = own_good = all_good = 0.0
    limit = None
    for at in sorted({b[1] for b in bins}, reverse=True):
        for mine, _, n, good in (b for b in bins if b[1] == at):
            all_, all_good = all_ + n, all_good + good
            own, own_good = own + n * mine, own_good + good * mine
        if own_good + weight * all_good / all_ >= precision * (own + weight):
            limit = at / 50
    return limit


def _learn(spans: DataFrame, precision: float) -> DataFrame | None:
    """Proposals outside the base that the trees accept: row, kind, start, end, text, score.

    Every labelled proposal is used, with what is made from it: a hash of its document and
    place (so that the partitioning of the table changes nothing) gives every fifth to the
    thresholds (:func:`_limit`, but 0.5 at least) and the others to the trees. Rows of equal
    numbers are one row that weighs as many. None if there is nothing to tell apart.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    proposed = spans.select("row", "doc_id", "h", F.posexplode("proposed").alias("place", "p")).select("row", "doc_id", "h", "place", F.col("p.c").alias("c"), F.col("p.before").alias("before"), F.col("p.after").alias("after"))
    bases = _celled(spans.select("row", F.explode("base").alias("b")), "b").select("row", "cell", "b")
    met = _celled(proposed.select("row", "place", "c"), "c").join(bases, ["row", "cell"]).where(_overlap(F.col("b"), F.col("c")))
    b, c = F.col("b"), F.col("c")
    kind, inside, exact = b["kind"] == c["kind"], (b["start"] <= c["start"]) & (b["end"] >= c["end"]), (b["start"] == c["start"]) & (b["end"] == c["end"])
    flags = met.groupBy("row", "place").agg(F.bool_or(kind & inside).alias("same"), F.bool_or(kind & exact).alias("exact"), F.lit(True).alias("touches"))
    rows = proposed.join(flags, ["row", "place"], "left")
    same, touches = (F.coalesce(F.col(n), F.lit(False)) for n in ("same", "touches"))
    rows = rows.withColumn("label", F.when(same, 1.0).when(touches | _broken(), 0.0)).withColumn("free", ~touches).withColumn("exact", F.coalesce("exact", F.lit(False)))
    slot = F.pmod(F.xxhash64("doc_id", "h", "c.start", "c.kind"), F.lit(1_000_000))
    told = written(rows.select("row", "c", "before", "after", "label", "free", "exact", slot.alias("slot")), "pii-told")
    # features take a large expression: few rows to a task would spend their time on setting it up
    table_ = written(_features(told), "pii-proposals", rows=told.count())
    counts = {(r["label"], r["exact"]): r["count"] for r in table_.where("label IS NOT NULL").groupBy("label", "exact").count().collect()}
    if all(label != 1.0 for label, _ in counts):
        return None
    told_ = table_.where("label IS NOT NULL")
    alone = F.col("slot") % 2 == 0  # half of them stand without context, so that it cannot decide everything
    known = told_.where("exact").withColumns({"t": F.col("c.text"), "d": _digits(F.col("c.text")), "before": F.when(alone, " ").otherwise(F.col("before")), "after": F.when(alone, " ").otherwise(F.col("after"))})
    other = None
    for k in range(len(KINDS)):  # kind by kind, or the expressions outgrow a compiled method
        one = known.where(F.col("c.kind") == k).select("slot", "before", "after", F.explode(_made(k)).alias("m"))
        one = one.select("slot", F.struct(F.lit(k).alias("kind"), F.col("m.text").alias("text")).alias("c"), "before", "after", F.col("m.label").alias("label"))
        other = one if other is None else other.unionByName(one)
    exact = sum(n for (_, exact), n in counts.items() if exact)
    other = _features(written(other, "pii-made", rows=MADE * exact))
    columns = (F.col("c.kind").alias("kind"), "label", (F.col("slot") % 5 == 0).alias("held"), "numbers")
    weighed = told_.select(*columns).unionByName(other.select(*columns)).groupBy("kind", "label", "held", "numbers").agg(F.count("*").cast("double").alias("n"))
    # few files where there are few rows, so that each round of boosting is a few tasks
    labelled = written(weighed, "pii-labelled")
    labelled = written(labelled, "pii-weighed", rows=labelled.count()).withColumn("features", array_to_vector("numbers"))
    training = labelled.where("NOT held")
    if training.groupBy("label").count().count() < 2:
        return None
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="n", maxIter=20, maxDepth=5, maxBins=32, seed=1, cacheNodeIds=False).fit(training.select("label", "features", "n"))
    score = lambda rows: trees.transform(rows).withColumn("score", vector_to_array("probability")[1])
    bins = score(labelled.where("held")).groupBy("kind", F.floor(F.col("score") * 50).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).collect()
    accept = F.lit(False)
    for k in range(len(KINDS)):
        limit = _limit([(b["kind"] == k, b["bin"], b["n"], b["good"]) for b in bins], precision)
        if limit is not None:
            accept = accept | (F.col("c.kind") == k) & (F.col("score") >= max(limit, 0.5))
    new = score(table_.where("free AND label IS NULL").withColumn("features", array_to_vector("numbers")))
    return new.where(accept).select("row", F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), F.col("c.text").alias("text"), "score")


def _search(docs: DataFrame, precision: float) -> tuple[DataFrame, DataFrame | None]:
    """(row, doc_id, h, base, proposed) of every row, written; and by row, the proposals that stay, if any could."""
    first = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key().alias("h"), _of_kinds(base_spans(F.col("text"))).alias("base"), proposals(F.col("text")).alias("proposed"))
    spans = written(first, "pii-spans")
    extra = _learn(spans.where(F.size("proposed") > 0), precision)
    if extra is None:
        return spans, None
    extra = written(extra.select("row", F.struct("start", "kind", "end", "text", "score").alias("a")), "pii-accepted")
    near = _celled(extra, "a")
    pairs = near.join(near.select("row", "cell", F.col("a").alias("b")), ["row", "cell"])
    a, b = F.col("a"), F.col("b")
    worse = _overlap(a, b) & ((b["score"] > a["score"]) | (b["score"] == a["score"]) & ((b["start"] < a["start"]) | (b["start"] == a["start"]) & (b["kind"] < a["kind"])))
    best = extra.join(pairs.where(worse).select("row", "a").distinct(), ["row", "a"], "left_anti")
    added = F.sort_array(F.collect_list(F.struct("a.start", "a.kind", "a.end", "a.text"))).cast(_SPAN)
    return spans, best.groupBy("row").agg(added.alias("extra"))


def find_spans(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, text) for every row of ``docs`` (doc_id, text).

    ``base`` holds what the exact rules find; ``spans`` adds the accepted proposals that
    overlap no base span; of proposals that overlap each other, the one scored highest
    stays (of ties, the earlier, then the kind listed first). Null and empty texts have no
    spans; rows with null or repeated doc_ids are searched each for itself; no rows give
    no rows; other columns are ignored.
    """
    spans, extra = _search(docs, precision)
    if extra is None:
        return spans.select("doc_id", "base", F.col("base").alias("spans"))
    joined = spans.select("row", "doc_id", "base").join(extra, "row", "left")
    whole = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra")))
    return joined.select("doc_id", "base", whole.alias("spans"))


def _gaps(spans: Column) -> Column:
    """(from, to, kind) of the text before each span that begins after all earlier ones end; the last goes to the end of all texts."""
    far = F.struct(F.lit(2**62).alias("start"), F.lit(-1).alias("kind"), F.lit(2**62).alias("end"), F.lit("").alias("text"))

    def of(whole: Column) -> Column:
        ends = F.transform(whole, lambda s: s["end"])
        gap = lambda at, s, i: F.struct(at(i).alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        gaps = _let(ends, lambda e: _before(e, lambda x, y: F.greatest(x, y), F.lit(0).cast("long"), lambda at: F.transform(whole, lambda s, i: gap(at, s, i))))
        return F.filter(gaps, lambda g: g["to"] >= g["from"])

    return _let(F.concat(spans, F.array(far).cast(_SPAN)), of)


def redact(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, as [EMAIL]; other columns stay.

    Overlapping spans become one, named after the first. Base spans are found again where
    the text lies, so texts are not shuffled to meet them; accepted proposals are few, and
    come by doc_id and text, so that a row gets none but its own where doc_ids are null or
    repeat. Null and empty texts stay as they are. Columns may have any names.
    """
    found, extra = _search(docs, precision)
    i, h, spans, more = (unused(docs, name) for name in ("doc_key", "text_key", "spans", "more_spans"))
    out = docs.withColumn(spans, _of_kinds(base_spans(F.col("text"))))
    if extra is not None:
        own = extra.join(found.select("row", "doc_id", F.col("h").alias("text_hash")), "row").groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.first("extra").alias(more))
        out = out.join(small(written(own, "pii-extra"), BROADCAST_DOCS), [F.col("doc_id").eqNullSafe(F.col(i)), text_key() == F.col(h)], "left")
        out = out.withColumn(spans, F.when(F.col(more).isNull(), F.col(spans)).otherwise(F.sort_array(F.concat(spans, more))))
    gaps, blocks = unused(docs, "gaps"), unused(docs, "blocks")
    out = out.withColumn(gaps, _gaps(F.col(spans))).withColumn(blocks, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), 0))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def block(piece: Column, number: Column) -> Column:
        """A block of the text without what lies in spans; a span's name stands in the block that it starts in."""
        first = number.cast("long") * _BLOCK

        def put(g: Column) -> Column:
            start = F.greatest(g["from"] - first, F.lit(0))
            kept = F.substr(piece, (start + 1).cast("int"), F.greatest(F.least(g["to"] - first, F.lit(_BLOCK)) - start, F.lit(0)).cast("int"))
            return F.concat(kept, F.when(g["to"].between(first, first + _BLOCK - 1), F.get(names, g["kind"])).otherwise(F.lit("")))

        here = F.filter(F.col(gaps), lambda g: (g["to"] >= first) & (g["from"] < first + _BLOCK))
        return F.array_join(F.transform(here, put), "")

    clean = F.array_join(F.transform(F.col(blocks), block), "")
    return out.withColumn("text", F.when(F.col("text").isNull() | (F.size(spans) == 0), F.col("text")).otherwise(clean)).select(*docs.columns)


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
