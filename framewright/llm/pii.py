"""Personal data by candidate gradient boosting, in DataFrame operations and pyspark.ml only.

Base detectors give exact spans of four kinds. High-recall generators propose further, overlapping spans: written-out
or bracketed mail addresses, numbers in groups with any separators, addresses with odd dots. Boosted trees score each
candidate by its format and context. A strict check labels candidates of plain format (mail addresses with a plain domain
against ends of sentences, parts up to 255, check digits, digit counts after a plus). Each labelled candidate also has hidden
forms: at and dot written out or in brackets, other separators, no plus, with its label, and a date made of a phone number's
digits, with label 0; so are numbers without a plus that lie on a base span. So a plain format by itself tells no label,
and the trees know the forms that base detectors miss. They are fitted on at most TRAIN_ROWS labelled candidates and their
hidden forms; all others calibrate: a kind's threshold is the lowest score from which at least PRECISION of its candidates and
of its hidden forms are right; where there is none, nothing is added. Candidates from it on are taken by score, those that
overlap a base span or a better candidate are dropped. Base spans always stay.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are judged each on its own; without candidates
of both labels nothing is added; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bind
from .tables import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. They match as written in the contract, but do not backtrack and do not start inside
#: a run of characters in which an earlier start has failed already, so long runs take linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals beyond the base patterns, by kind.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,4}+){3}+",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._-]{0,2}[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]{0,2}[0-9]{1,4}[)]?(?:[ .-]{1,2}[(]?[0-9]{2,5}[)]?){2,4}(?![0-9A-Za-z])",
}
#: At most so many labelled candidates fit the trees, those with the smallest hash of doc_id, text and span.
TRAIN_ROWS = 20_000
PRECISION = 0.98
CONTEXT = 24


#: Matches that are placed one after another before blocks of them are: work grows with the matches of a text, not their square.
_TOGETHER = 256
_SPANS = "array<struct<start:int,end:int,match:string>>"


def located(text: Column, pattern: str) -> Column:
    """array of (start, end, match) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def add(state: Column, item: Column) -> Column:
        at = state["at"] + item["gap"]
        end = at + F.length(item["match"])
        return F.struct(F.array_append(state["spans"], F.struct(at.alias("start"), end.alias("end"), item["match"].alias("match"))).alias("spans"), end.alias("at"))

    def block(items: Column, b: Column) -> Column:
        return F.aggregate(F.slice(items, b * _TOGETHER + 1, F.lit(_TOGETHER)), F.struct(F.array().cast(_SPANS).alias("spans"), F.lit(0).alias("at")), add)

    def shifted(state: Column, own: Column) -> Column:
        moved = bind(state["at"], lambda at: F.transform(own["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["match"].alias("match"))))
        return F.struct(F.array_append(state["spans"], moved).alias("spans"), (state["at"] + own["at"]).alias("at"))

    def placed(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / _TOGETHER).cast("int") - 1))
        blocks = F.transform(numbers, lambda b: block(items, b))
        return F.aggregate(blocks, F.struct(F.array().cast(f"array<{_SPANS}>").alias("spans"), F.lit(0).alias("at")), shifted, lambda s: F.flatten(s["spans"]))

    both = F.struct(found.alias("found"), gaps.alias("gaps"))
    items = bind(both, lambda x: F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.struct(g.alias("gap"), m.alias("match"))))
    return bind(items, placed)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the last digit check the others?"""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def strict(kind: Column, match: Column) -> Column:
    """The base check of a match: parts of an ip, digits of a card and a phone number."""
    digits = _digits(match)
    small = match.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", small).when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)).otherwise(F.length(digits).between(9, 15))


def base_spans(text: Column) -> Column:
    """array of (kind, start, end), by kind as listed, then start."""

    def of(kind: str) -> Column:
        good = F.filter(located(text, BASE[kind]), lambda s: strict(F.lit(kind), s["match"]))
        spans = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(text.rlike(BASE[kind]), spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))

    return F.concat(*map(of, KINDS))


def proposals(text: Column) -> Column:
    """array of (kind, start, end, match, before, after) that the generators propose."""

    def of(kind: str) -> Column:
        def span(s: Column) -> Column:
            before = F.substring(text, F.greatest(F.lit(1), s["start"] - CONTEXT + 1), F.least(s["start"], F.lit(CONTEXT)))
            after = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), before.alias("before"), after.alias("after"))

        none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>")
        return F.when(text.rlike(WIDE[kind]), F.transform(located(text, WIDE[kind]), span)).otherwise(none)

    return F.concat(*map(of, KINDS))


def features() -> dict[str, Column]:
    """Format and context of a candidate (kind, match, before, after)."""
    m, before, after = F.col("match"), F.col("before"), F.col("after")

    def count(pattern: str, of: Column = m) -> Column:
        return F.length(F.regexp_replace(of, f"[^{pattern}]", "")).cast("double")

    word = F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]{0,3}$", 1)
    return {
        **{f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS},
        "length": F.length(m).cast("double"),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "dots": count("."),
        "blanks": count(" "),
        "dashes": count(r"\-"),
        "brackets": count(r"()\[\]{}"),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "longest_group": F.array_max(F.transform(F.concat(F.array(F.lit("")), F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), lambda g: F.length(g))).cast("double"),
        "kinds_of_digit": F.size(F.array_distinct(F.split(_digits(m), ""))).cast("double"),
        "plus": m.startswith("+").cast("double"),
        "glued_before": before.rlike(r"[A-Za-z0-9_/.@#-]$").cast("double"),
        "glued_after": after.rlike(r"^[A-Za-z0-9_/@#]").cast("double"),
        "label_before": F.lower(word).isin("tel", "phone", "call", "mobile", "fax", "mail", "email", "card", "visa", "ip", "address", "contact").cast("double"),
        "check_digit": F.coalesce(F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))), F.lit(False)).cast("double"),
        "small_parts": F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(F.regexp_replace(g, "^0+", "")) < 4).cast("double"),
        "byte_parts": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]{1,9}"), F.lit(0)), lambda g: g.cast("int"))) <= 255, F.lit(False)).cast("double"),
        "blank_after_dot": m.rlike(r"[^ ]\. ").cast("double"),
        "capital_last": m.rlike(r"[^A-Za-z][A-Z][a-z]*$").cast("double"),
        "line_start": (before.rlike(r"\n\s*$") | (before == "")).cast("double"),
    }


def label() -> Column:
    """What a strict check says of a candidate: 1, 0, or null where it cannot tell."""
    m, kind = F.col("match"), F.col("kind")
    plain = m.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    # "met at noon. Then" ends a sentence; "bob at host dot org" and "bob at host.org" may be addresses
    sentence = ~m.rlike(r"(?i)[(\[{](at|dot)[)\]}]| dot ") & ~m.contains("@") & m.rlike(r"[^ ]\. ")
    return (
        F.when(kind == "email", F.when(plain, 1.0).when(sentence, 0.0))
        .when(kind == "ip", F.when(m.rlike(r"^[0-9.]+$"), strict(kind, m).cast("double")))
        .when(kind == "card", strict(kind, m).cast("double"))
        .otherwise(F.when(m.startswith("+"), strict(kind, m).cast("double")))
    )


def disguises(order: Column) -> Column:
    """array of (match, label) that a labelled candidate (kind, match, label) also trains as; order chooses the form."""
    m, kind = F.col("match"), F.col("kind")

    def pick(values: list[str], part: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.shiftright(order, 5 * part), F.lit(len(values))) + 1).cast("int"))

    at, dot = pick([" (at) ", "(at)", " [at] ", "[at]", "{at}", " at "], 0), pick([" (dot) ", "(dot)", "[dot]", " dot ", "."], 1)
    local, domain = F.regexp_extract(m, r"^(.*?) ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?(.*)$", 1), F.regexp_extract(m, r"^(.*?) ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?(.*)$", 2)
    mail = F.concat(local, at, F.when(F.col("label") == 1, F.replace(domain, F.lit("."), dot)).otherwise(domain))
    ip = F.replace(m, F.lit("."), pick(["[.]", "(.)", " . "], 0))
    card = F.call_function("concat_ws", pick([" ", "-", ".", "_", " - "], 0), F.regexp_extract_all(_digits(m), F.lit("[0-9]{1,4}"), F.lit(0)))
    digits = _digits(m)
    # the same number as it is dialled at home or from abroad, and a date
    groups = F.call_function("concat_ws", pick([" ", "-", "."], 1), F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.expr("substring(regexp_replace(match, '[^0-9]', ''), 7)"))
    home = F.call_function("concat_ws", pick([" ", "-", "."], 2), F.concat(F.lit("0"), F.substring(digits, 2, 2)), F.substring(digits, 4, 4), F.substring(digits, 8, 4))
    phone = F.when(m.startswith("+"), F.when(F.pmod(order, F.lit(2)) == 0, F.expr("substring(match, 2)")).otherwise(groups)).otherwise(m)
    year, month, day = F.concat(F.lit("20"), F.substring(digits, 3, 2)), F.concat(F.lit("0"), F.substring(digits, 5, 1)), F.concat(F.lit("1"), F.substring(digits, 6, 1))
    dates = [F.call_function("concat_ws", pick(["-", ".", " "], 1), *parts) for parts in ((year, month, day), (day, month, year))]

    def form(match: Column, value: Column) -> Column:
        return F.struct(match.alias("match"), value.cast("double").alias("label"))

    same = F.col("label")
    mails = F.array(form(mail, same), form(F.regexp_replace(mail, "[0-9]", ""), same))
    phones = F.when(same == 1, F.array(form(phone, same), form(home, same), *[form(d, F.lit(0.0)) for d in dates])).otherwise(F.array(form(phone, same)))
    return F.when(kind == "email", mails).when(kind == "ip", F.array(form(ip, same))).when(kind == "card", F.array(form(card, same))).otherwise(phones)


def _lowest(scored: DataFrame) -> dict[str, float]:
    """For each kind, the lowest score from which PRECISION of its rows (kind, score, label) are right, if any."""
    rows = scored.groupBy("kind", F.round("score", 3).alias("score")).agg(F.count("*").alias("n"), F.sum("label").alias("right")).orderBy("kind", F.desc("score")).collect()
    best, n, right = {}, {}, {}
    for r in rows:  # at most 1,001 scores a kind
        n[r["kind"]], right[r["kind"]] = n.get(r["kind"], 0) + r["n"], right.get(r["kind"], 0) + r["right"]
        if right[r["kind"]] >= PRECISION * n[r["kind"]]:
            best[r["kind"]] = r["score"]
    return best


def _threshold(scored: DataFrame) -> dict[str, float]:
    """Thresholds from the labelled candidates that did not train."""
    return _lowest(scored)


def added_spans(candidates: DataFrame) -> DataFrame:
    """(row, kind, start, end, score) of the open candidates (row, hash, kind, start, end, match, before, after, open) that trees select."""
    named = features()
    collect = VectorAssembler(inputCols=list(named), outputCol="features")

    def ready(rows: DataFrame, *keep: str) -> DataFrame:
        return collect.transform(rows.withColumns(named)).select("features", *keep)

    labelled = candidates.withColumn("label", label()).withColumn("order", F.xxhash64("hash", "kind", "start", "end"))
    known = labelled.where("label is not null")
    plain = cut(ready(known, "kind", "label", "order"), "plain")
    hidden = known.select("*", F.explode(disguises(F.col("order"))).alias("as")).withColumns({"match": F.col("as.match"), "label": F.col("as.label")}).drop("as")
    lying_on_base = labelled.where("kind = 'phone' and label is null and not open").withColumn("label", F.lit(0.0))
    hidden = cut(ready(hidden.unionByName(lying_on_base), "kind", "label", "order"), "hidden")
    chosen = plain.where("order % 3 <> 0").orderBy("order").limit(TRAIN_ROWS)
    seen = chosen.agg(F.count_distinct("label").alias("labels"), F.max("order").alias("last")).first()
    none = candidates.where("1 = 0").select("row", "kind", "start", "end", F.lit(0.0).alias("score"))
    if seen["labels"] < 2:
        return none
    trains = (F.col("order") % 3 != 0) & (F.col("order") <= seen["last"])
    # the hidden forms of the chosen ones, at most four each, and as many lying on base spans at most
    train = cut(chosen.union(hidden.where(trains).orderBy("order").limit(5 * TRAIN_ROWS).select(*chosen.columns)), "train")
    model = GBTClassifier(maxIter=20, maxDepth=5, seed=5, featuresCol="features", labelCol="label").fit(train)
    score = vector_to_array("probability")[1].alias("score")
    first, second = (model.transform(rows.where(~trains)).select("kind", score, "label") for rows in (plain, hidden))
    least, also = _threshold(first), _lowest(second)
    least = {k: max(least[k], also[k]) for k in least if k in also}
    if not least:
        return none
    scored = model.transform(ready(candidates.where("open"), "row", "kind", "start", "end")).select("row", "kind", "start", "end", score)
    floor = F.create_map(*[x for k, v in sorted(least.items()) for x in (F.lit(k), F.lit(v))])
    return cut(scored.where(F.round("score", 3) >= F.element_at(floor, F.col("kind"))), "added")


def candidates_of(found: DataFrame) -> DataFrame:
    """(row, hash, kind, start, end, match, before, after, open) of the proposals; open ones overlap no base span.

    Base spans and proposals of a text are swept once from either end, so work grows with their number.
    """
    proposals_ = found.select("row", "hash", F.explode("proposed").alias("p")).select("row", "hash", "p.*", F.lit(False).alias("is_base"))
    base = found.select("row", "hash", F.explode("base").alias("b")).select("row", "hash", "b.kind", "b.start", "b.end", F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(True).alias("is_base"))
    from_left = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    from_right = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.when(F.col("is_base"), F.col("end"))).over(from_left), F.lit(0)) <= F.col("start")
    begins = F.min(F.when(F.col("is_base"), F.col("start"))).over(from_right)
    swept = proposals_.union(base).withColumn("open", ended & F.coalesce(begins >= F.col("end"), F.lit(True)))
    return swept.where("not is_base").drop("is_base")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end), base spans by kind as listed and start."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(doc_id, body).alias("hash"), base_spans(body).alias("base"), proposals(body).alias("proposed"))
    found = cut(found, "found")
    chosen = added_spans(cut(candidates_of(found), "candidates"))
    # a span is dropped when a better one overlaps it: only spans of one place, where no gap lies between, are compared
    before = Window.partitionBy("row").orderBy("start", "end", "kind")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = chosen.withColumn("opens", F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1)))
    placed = opens.withColumn("at", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    better = placed.groupBy("row", "at").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "start", "end", "kind"))).alias("c"))

    def take(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    picked = better.select(F.col("row").alias("_row"), F.aggregate("c", none, take).alias("some")).groupBy("_row").agg(F.flatten(F.collect_list("some")).alias("added"))
    return found.join(picked, F.col("row") == F.col("_row"), "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start, as kind:start:end joined by commas."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_ordered(F.col("base")), 256).alias("base_sha256"), _ordered(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
