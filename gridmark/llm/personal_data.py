"""Personal data: fixed patterns, and bootstrapped contexts that find identifiers no pattern describes.

The fixed patterns give the seeds: e-mail addresses, IP addresses, card and phone numbers. All tokens
that hold a digit or an at sign are instances; the words around them are their patterns: the two words
before, the word before, and the words on both sides. On the graph of patterns and instances, seeds
score 1; so do tokens of a shape that only keys and digests have, which no fixed pattern covers. In every round a pattern's confidence is the mean score of its instances, lowered where it has few,
and an instance's score the mean confidence of its patterns. At last, believed tokens where no base span
covers them, in the context of a pattern of high confidence that seeds support SUPPORT times, become spans of kind `id`.

All of it is DataFrame functions. Positions come from splitting a text at the matches: the lengths of
gaps and matches add up to them. The regular expressions are possessive, so they neither backtrack
over long runs nor recurse.

Defined results: a null text is empty and has no spans; repeated rows have equal spans; a null doc_id is kept;
an empty table gives no rows; other columns are ignored, and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm import bit_filter
from gridmark.session import materialize

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
CONFIDENT, SUPPORT, PRIOR, BELIEVED = 0.8, 5, 2.0, 0.5
REACH = 64  # code points on either side that are read as context

# The leftmost match in a run of fitting characters begins where the run or the search does (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What lies between runs of digits joined by single blanks or hyphens.
NO_CARD = r"[^0-9\x20-][^0-9]*+|[\x20-][^0-9]++"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# Seeds by shape alone: long hexadecimal strings, as keys and digests are.
SHAPE = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
BLOCK = 256  # matches whose list grows one by one
SPAN = "array<struct<start:int,end:int,kind:int,found:string>>"


def _running(first: Column, second: Column, kind: int, second_is_match: bool) -> Column:
    """Spans of the pieces `second` (or `first`) of a text that is first[0] second[0] first[1] ...

    Lists grow within blocks, and the list of all by whole blocks, so that a text of many matches costs little more than each of them.
    """
    empty = F.expr(f"cast(array() as {SPAN})")
    count = F.size(second) if second_is_match else F.size(first)

    def step(acc: Column, i: Column) -> Column:
        a = F.length(F.get(first, i))
        b = F.coalesce(F.length(F.get(second, i)), F.lit(0))
        at = acc["at"] + a
        start, end, found = (at, at + b, F.get(second, i)) if second_is_match else (acc["at"], at, F.get(first, i))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), found.alias("found"))
        return F.struct((at + b).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(acc: Column, k: Column) -> Column:
        inside = F.sequence(k * BLOCK, F.least(k * BLOCK + BLOCK, count) - 1)
        joined = lambda part: F.struct(part["at"].alias("at"), F.concat(acc["spans"], part["spans"]).alias("spans"))
        return F.aggregate(inside, F.struct(acc["at"].alias("at"), empty.alias("spans")), step, joined)

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(count > 0, F.aggregate(_blocks(count), start, block)["spans"]).otherwise(empty)


def _blocks(count: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def _ip_holds(found: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, r"^0++", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), small)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).try_cast("int")
        double = (n - i) % 2 == 1
        return total + F.when(double, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card_holds(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def base_spans(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns, `base`: the spans of the fixed patterns, and `_tokens`: all instances with the text around them.

    Patterns are only searched in texts that hold what every match holds.
    """
    text = F.coalesce(F.col(text), F.lit(""))
    wanted = {
        "mail": (text.contains("@"), EMAIL), "ip": (text.rlike(r"[0-9]\.[0-9]"), IP),
        "phone": (text.rlike(r"\+[0-9]"), PHONE), "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), NO_CARD),
        "token": (text.rlike("[0-9@]"), TOKEN),
    }
    none = F.expr("cast(array() as array<string>)")
    parts = []
    for name, (worth, pattern) in wanted.items():
        parts.append(F.when(worth, F.split(text, pattern, -1)).otherwise(none).alias(f"_{name}_gaps"))
        parts.append(F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"_{name}_found"))
    cut = docs.select(*columns, *parts)

    def spans(name: str, kind: int) -> Column:
        return _running(F.col(f"_{name}_gaps"), F.col(f"_{name}_found"), kind, True)

    def trimmed(span: Column) -> Column:
        """A piece at the ends of a text can have a blank or hyphen too much."""
        left = F.length(F.regexp_extract(span["found"], r"^[\x20-]*", 0))
        right = F.length(F.regexp_extract(span["found"], r"[\x20-]?$", 0))
        return F.struct((span["start"] + left).alias("start"), (span["end"] - right).alias("end"), span["kind"].alias("kind"), span["found"].alias("found"))

    mails = spans("mail", 0)
    ips = F.filter(spans("ip", 1), lambda s: _ip_holds(s["found"]))
    phones = F.filter(spans("phone", 3), lambda s: F.length(_digits(s["found"])).between(10, 15))
    cards = _running(F.col("_card_gaps"), F.col("_card_found"), 2, False)
    cards = F.transform(F.filter(cards, lambda s: (F.length(s["found"]) >= 14) & _card_holds(s["found"])), trimmed)
    order = F.transform(F.concat(mails, ips, cards, phones), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    around = lambda t, i: F.struct(
        t["start"].alias("start"), t["found"].alias("found"),
        F.substring(F.get(F.col("_token_gaps"), i), -REACH, REACH).alias("before"), F.substring(F.get(F.col("_token_gaps"), i + 1), 1, REACH).alias("after"),
    )
    tokens = F.transform(_running(F.col("_token_gaps"), F.col("_token_found"), 4, True), around)
    return cut.select(*columns, F.array_sort(order).alias("base"), tokens.alias("_tokens"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def instances(spans: DataFrame) -> DataFrame:
    """row, start, end, token, covered, seed, and the contexts of every token with a digit or an at sign.

    A token is covered where a base span overlaps it; seeds are covered or have a shape that only identifiers have.
    """
    rows = spans.select("row", F.inline("_tokens"))
    lead = F.length(F.regexp_extract("found", r"^[^\p{L}\p{N}]*+", 0))
    body = F.regexp_replace(F.regexp_replace("found", r"^[^\p{L}\p{N}]++", ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    rows = rows.select(
        "row", (F.col("start") + lead).alias("start"), body.alias("token"), _words(F.col("before")).alias("l"), _words(F.col("after")).alias("r"),
    ).where(F.length("token") > 0).withColumn("end", F.col("start") + F.length("token"))
    one, two = F.coalesce(F.try_element_at("l", F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at("l", F.lit(-2)), F.lit(""))
    after = F.coalesce(F.try_element_at("r", F.lit(1)), F.lit(""))
    patterns = F.filter(
        F.array(
            F.when(one != "", F.concat(F.lit("1 "), one)),
            F.when((one != "") & (two != ""), F.concat(F.lit("2 "), two, F.lit(" "), one)),
            F.when((one != "") & (after != ""), F.concat(F.lit("3 "), one, F.lit(" _ "), after)),
        ),
        lambda p: p.isNotNull(),
    )
    # Of the base spans of a text that begin before a token ends, one reaches into it if that ending last does.
    tokens = rows.select("row", "start", "end", "token", patterns.alias("patterns"), F.col("end").alias("at"), F.lit(0).alias("reach"))
    base = spans.select("row", F.inline("base")).select("row", F.col("start").alias("at"), F.col("end").alias("reach"))
    upto = Window.partitionBy("row").orderBy("at", "reach").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = tokens.unionByName(base, allowMissingColumns=True).withColumn("reached", F.max("reach").over(upto)).where(F.col("token").isNotNull())
    covered = F.col("reached") > F.col("start")
    return marked.select("row", "start", "end", "token", covered.alias("covered"), (covered | F.col("token").rlike(SHAPE)).alias("seed"), "patterns")


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) of those that are trusted, and (token, score) of those that are believed."""
    seeds = found.where("seed").select("token", F.lit(1).alias("seed")).distinct()  # also where no words are around
    edges = found.select(F.explode("patterns").alias("pattern"), "token").groupBy("pattern", "token").agg(F.count("*").alias("n"))
    edges = materialize(edges.join(seeds, "token", "left").select("pattern", "token", "n", F.coalesce("seed", F.lit(0)).alias("seed")))
    scores = materialize(edges.groupBy("token").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("seed")))
    for _ in range(rounds):
        weighed = edges.drop("seed").join(scores, "token").groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / (F.sum("n") + PRIOR)).alias("confidence"), F.sum(F.col("n") * F.col("seed")).alias("seeds")
        )
        patterns = materialize(weighed)
        back = edges.join(patterns, "pattern").groupBy("token").agg(
            (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("score"), F.max("seed").alias("seed")
        )
        scores = materialize(back.select("token", F.when(F.col("seed") > 0, 1.0).otherwise(F.col("score")).alias("score"), "seed"))
    trusted = patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SUPPORT)).select("pattern", "confidence")
    return trusted, scores.where(F.col("score") >= BELIEVED).select("token", "score")


def discovered(found: DataFrame) -> DataFrame:
    """row, start, end of tokens that trusted patterns find where no base span covers them, whatever covers them elsewhere."""
    trusted, believed = confident_patterns(found)
    open_ = found.where(~F.col("covered")).join(believed, "token", "left_semi")
    hits = open_.select("row", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern", "left_semi")
    return hits.select("row", "start", "end").distinct()


def _listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _with_all_spans(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns, `base`, and `all`: base and discovered spans by start, then kind."""
    stored = materialize(base_spans(docs, columns, text).withColumn("row", F.monotonically_increasing_id()))
    found = materialize(instances(stored.select("row", "base", "_tokens")))
    new = materialize(discovered(found).groupBy("row").agg(
        F.collect_list(F.struct(F.col("start").alias("start"), F.lit(4).alias("kind"), F.col("end").alias("end"))).alias("new")
    ))
    # Rows without new spans stay where they are, with their texts.
    some, others = bit_filter.split(stored.drop("_tokens"), "row", new.select("row"))
    every = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return some.join(new, "row", "left").withColumn("all", every).drop("new").unionByName(others.withColumn("all", F.col("base")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    rows = _with_all_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their own columns; every span of a text is replaced by its kind in brackets.

    Of overlapping spans the first is named, and the rest of the others goes with it.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = _with_all_spans(packed, ["doc"], "doc.text")
    text = F.col("doc.text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, i: Column) -> Column:
        s = F.get(F.col("all"), i)
        fresh = s["start"] >= acc["at"]
        between = F.substring(acc["piece"], acc["at"] - acc["from"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], between, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"), acc["piece"].alias("piece"), acc["from"].alias("from"),
        )

    def block(acc: Column, k: Column) -> Column:
        """Blocks of spans cut their own piece off the text, since a substring is found by counting from the start."""
        last = F.least(k * BLOCK + BLOCK, F.size("all")) - 1
        piece = F.substring(text, acc["at"] + 1, F.greatest(F.get(F.col("all"), last)["start"] - acc["at"], F.lit(0)))
        begin = F.struct(acc["at"].alias("at"), F.lit("").alias("out"), piece.alias("piece"), acc["at"].alias("from"))
        joined = lambda part: F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"))
        return F.aggregate(F.sequence(k * BLOCK, last), begin, step, joined)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    built = F.aggregate(_blocks(F.size("all")), start, block, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("all") > 0, built).otherwise(text)
    return rows.select(*[clean.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
