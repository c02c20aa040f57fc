"""Personal data spans by weak supervision: labelers vote, EM weighs them, a classifier learns from the result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and the look-behind don't change what they match, but keep the time
#: in proportion to the text, and the stack flat, for very long runs of one class.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose matches are candidates only.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9.-])[0-9]{4}+(?:[\x20./-][0-9]{4}+){3}(?![0-9])|(?<![0-9.-])[0-9]{13,19}+(?![0-9])",
    "phone": r"(?<![0-9+(])(?:00[1-9][0-9]?[\x20.-]?)?\(?[0-9]{3}+\)?[\x20./-][0-9]{3}+[\x20.-][0-9]{4}+(?![0-9])",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "loose email": r"(?i)[\[(\x20]at[\])\x20]", "ip": r"[0-9]\.[0-9]", "loose ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|[\[(]\.[\])]", "card": r"[0-9]", "phone": r"\+[0-9]", "loose card": r"[0-9]{4}", "loose phone": r"[0-9]{3}"}
#: Gazetteers, fixed values: endings of domains (generic ones and countries), first digits of card numbers by
#: network, country calling codes, area codes without one, and networks whose addresses belong to nobody.
DOMAIN_ENDINGS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "co", "me", "tv", "app", "dev", "ai", "eu",
    "ae", "ar", "at", "au", "be", "bg", "br", "by", "ca", "ch", "cl", "cn", "cr", "cy", "cz", "de", "dk", "ec", "ee", "eg", "es", "fi", "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in",
    "ir", "is", "it", "jp", "ke", "kr", "kz", "lt", "lu", "lv", "ma", "mx", "my", "ng", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "sa", "se", "sg", "si", "sk", "th", "tn",
    "tr", "tw", "ua", "uk", "us", "uy", "ve", "vn", "za",
)
CARD_STARTS = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|3[689]|35(?:2[89]|[3-8])|6011|62|64[4-9]|65)"
CALLING_CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[058]|9[679])[0-9])"
AREA_CODES = r"^[2-9](?!11)[0-9]{2}[2-9][0-9]{6}$"
NOBODYS_NETWORKS = r"^(?:0|127|22[4-9]|2[3-5][0-9]|10|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|192\.0\.2|198\.51\.100|203\.0\.113)\."
#: Words that announce personal data.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|t[eé]l[eé]fono?)\b",
}
#: Words near a number that speak against personal data.
COUNTER_CUES = r"(?i)\b(?:order|invoice|version|isbn|page|id|no|nr|total|sha|hash|serial)\b"
LABELERS = ("base", "shape", "checksum", "gazetteer", "cue", "counter_cue")
CONTEXT_CHARS = 40
CONTEXT_BUCKETS = 256
ACCEPT = 0.9
EM_ROUNDS = 50


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def octets(text: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(digits_of(match))
    return F.when(kind == "ip", octets(match)).when(kind == "card", n.between(14, 19) & luhn(digits_of(match))).when(kind == "phone", n.between(10, 15)).otherwise(True)


def entries(kind: str, base: bool, between: Column):
    """What to keep of the i-th match, given the texts between all matches."""

    def entry(match: Column, i: Column) -> Column:
        gap = F.get(between, i)
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.cast("int").alias("i"), F.char_length(gap).alias("gap"), match.alias("match"),
            F.right(gap, F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(between, i + 1), F.lit(CONTEXT_CHARS)).alias("after"),
        )

    return entry


def matches(docs: DataFrame) -> DataFrame:
    """row, id, kind, base, start, end, match, before, after of each match in (id, text); and a row of kind null for each document.

    Spark gives matches without places. The text between them, by splitting at the same pattern, gives the
    places as running sums of lengths.
    """
    wanted = [(kind, True, BASE[kind], NEEDS[kind]) for kind in KINDS] + [(kind, False, LOOSE[kind], NEEDS[f"loose {kind}"]) for kind in KINDS]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    found, columns = [], ["row", "id"]
    for k, (_, _, pattern, need) in enumerate(wanted):
        has = F.contains("text", F.lit(need)) if need == "@" else F.col("text").rlike(need)
        none = F.array().cast("array<string>")
        texts = texts.withColumn(f"m{k}", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        texts = texts.withColumn(f"p{k}", F.when(F.size(f"m{k}") > 0, F.split("text", pattern, -1)).otherwise(none))
        columns += [f"m{k}", f"p{k}"]
    for k, (kind, base, _, _) in enumerate(wanted):
        found.append(F.transform(F.col(f"m{k}"), entries(kind, base, F.col(f"p{k}"))))
    kind_of = "struct<kind:string,base:boolean,i:int,gap:int,match:string,before:string,after:string>"
    rows = texts.select(*columns).select("row", "id", F.explode(F.concat(F.array(F.lit(None).cast(kind_of)), *found)).alias("v")).select("row", "id", "v.*")
    upto = Window.partitionBy("row", "kind", "base").orderBy("i")
    length = F.char_length("match")
    end = F.sum(F.col("gap") + length).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("row", "id", "kind", "base", (end - length).alias("start"), end.alias("end"), "match", "before", "after")


def clear_of_base(spans: DataFrame) -> DataFrame:
    """Base spans, candidates that overlap none of them, and the rows that stand for documents."""
    order = Window.partitionBy("row").orderBy("start", F.desc("base"), "end")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    reach = F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(base_start).over(order.rowsBetween(0, Window.unboundedFollowing))
    clear = F.col("kind").isNull() | F.col("base") | ((F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.lit(1 << 60)) >= F.col("end")))
    return spans.withColumn("clear", clear).where("clear").drop("clear")


def votes(spans: DataFrame) -> DataFrame:
    """Adds a vote of each labeler: 1 for personal data, -1 against, 0 none."""
    kind, match, digits = F.col("kind"), F.col("match"), digits_of(F.col("match"))
    n = F.length(digits)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    shape = vote(
        F.when(kind == "email", match.contains("@")).when(kind == "card", match.rlike(r"^[0-9]{4}([\x20-]?[0-9]{4}){3}$|^3[0-9]{14}$")).when(kind == "phone", match.rlike(r"\([0-9]{3}\)|^\+|^00")).otherwise(~match.contains("[")),
        F.when(kind == "card", ~n.between(14, 19)).when(kind == "phone", ~n.between(10, 15)).otherwise(False),
    )
    checked = F.when(kind == "card", luhn(digits)).when((kind == "ip") & ~match.contains(":"), octets(match))
    abroad = F.regexp_extract(match, r"^(\+|00)", 1)
    gazetteer = (
        F.when(kind == "email", F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(*DOMAIN_ENDINGS))
        .when(kind == "card", digits.rlike(CARD_STARTS))
        .when(kind == "phone", F.when(abroad == "", digits.rlike(AREA_CODES)).otherwise(digits_of(F.regexp_replace(match, "^00", "")).rlike(CALLING_CODES)))
        .otherwise(F.when(match.contains(":"), match.rlike("^[23]")).otherwise(~F.regexp_replace(match, r"[\[\]()]", "").rlike(NOBODYS_NETWORKS)))
    )
    cue = F.when(kind == "email", F.col("before").rlike(CUES["email"]))
    for k in KINDS[1:]:
        cue = cue.when(kind == k, F.col("before").rlike(CUES[k]))
    columns = {
        "base": F.col("base").cast("int"),
        "shape": shape,
        "checksum": vote(checked, ~checked),
        "gazetteer": vote(gazetteer, ~gazetteer),
        "cue": cue.cast("int"),
        "counter_cue": -(F.col("before").rlike(COUNTER_CUES).cast("int")),
    }
    return spans.select("*", *[columns[name].alias(f"vote_{name}") for name in LABELERS])


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """The posterior of each pattern of votes, by expectation-maximisation over how often each occurs.

    Each labeler has a probability for each vote given the truth, and votes are independent given it. The
    first posteriors come from the sums of votes.
    """
    total = sum(n for _, n in patterns)
    posterior = [1 / (1 + math.exp(-2.0 * sum(votes))) for votes, _ in patterns]
    for _ in range(rounds if total else 0):
        mass = [1.0, 1.0]
        seen = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in LABELERS] for _ in range(2)]
        for (votes, n), p in zip(patterns, posterior, strict=True):
            for truth, share in ((1, p * n), (0, (1 - p) * n)):
                mass[truth] += share
                for j, v in enumerate(votes):
                    seen[truth][j][v] += share
        new = []
        for votes, _ in patterns:
            logs = [math.log(mass[t] / sum(mass)) + sum(math.log(seen[t][j][v] / sum(seen[t][j].values())) for j, v in enumerate(votes)) for t in range(2)]
            new.append(1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1])))))
        if max(abs(a - b) for a, b in zip(new, posterior, strict=True)) < 1e-9:
            break
        posterior = new
    return {votes: p for (votes, _), p in zip(patterns, posterior, strict=True)}


def features(spans: DataFrame) -> Column:
    """What the classifier sees of a span: never the votes themselves."""
    match = F.col("match")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[A-Za-z]+", "a"), "[0-9]", "9"), "(9{5})9+", "$1")
    word_before = F.lower(F.regexp_extract("before", r"([\p{L}]+)[^\p{L}]*$", 1))
    values = {
        "shape": F.left(shape, F.lit(24)),
        "length": F.floor(F.log2(F.char_length(match).cast("double")) * 2).cast("string"),
        "digits": F.length(digits_of(match)).cast("string"),
        "before": F.pmod(F.xxhash64(word_before), F.lit(CONTEXT_BUCKETS)).cast("string"),
        "edge": F.concat(F.right("before", F.lit(1)), F.lit("|"), F.left("after", F.lit(1))),
    }
    # Hashed into buckets, so that the table of weights has a fixed size.
    return F.array(*[F.concat_ws("=", F.lit(name), F.pmod(F.xxhash64(value), F.lit(CONTEXT_BUCKETS)).cast("string")) for name, value in values.items()])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base_spans, spans (arrays of kind, start, end), in the order of start and kind.

    Places are in code points, ends exclusive. Base spans are the leftmost matches of the base patterns that pass
    their checks. Looser patterns give candidates, which count if they overlap no base span and the classifier
    finds them likely enough. Labelers (base pattern, shape, checksum, gazetteer, words before) vote on all
    spans; expectation-maximisation over the counts of vote patterns, for each kind, gives posteriors; and a naive
    Bayes classifier over hashed features of a span and its surroundings is fitted to them. What the driver holds
    has a fixed size: the vote patterns are at most 3**6 for each kind. Null and empty texts have no spans; each
    row stands for itself, repeated ids too; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = matches(base).where(F.col("kind").isNull() | ~F.col("base") | valid(F.col("kind"), F.col("match")))
    spans = stage(clear_of_base(raw), "spans")
    names = [f"vote_{name}" for name in LABELERS]
    voted = stage(votes(spans.where("kind is not null")).withColumn("features", features(spans)), "votes")
    counted: dict[str, list] = {}
    for row in voted.groupBy("kind", *names).count().collect():
        counted.setdefault(row["kind"], []).append((tuple(row[n] for n in names), row["count"]))
    posteriors = [(kind, *pattern, p) for kind, patterns in counted.items() for pattern, p in reliabilities(sorted(patterns)).items()]
    labels = spark.createDataFrame(posteriors, ", ".join(["kind string", *[f"{n} int" for n in names], "posterior double"]))
    labelled = voted.join(F.broadcast(labels), ["kind", *names])
    weighed = labelled.select("kind", "posterior", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("posterior").alias("yes"), F.sum(1 - F.col("posterior")).alias("no"))
    totals = labelled.groupBy("kind").agg(F.sum("posterior").alias("all_yes"), F.sum(1 - F.col("posterior")).alias("all_no"))

    def share(truth: str) -> Column:
        return (F.col(truth) + 0.5) / (F.col(f"all_{truth}") + 0.5 * CONTEXT_BUCKETS)  # half a count for each bucket

    weights = weighed.join(F.broadcast(totals), "kind").select("kind", "feature", F.log(share("yes") / share("no")).alias("weight"))
    weights = stage(weights, "weights")
    candidates = voted.where(~F.col("base")).withColumn("span", F.struct("row", "start", "end", "kind"))
    scored = (
        candidates.select("span", "kind", F.explode("features").alias("feature")).join(F.broadcast(weights), ["kind", "feature"]).groupBy("span", "kind").agg(F.sum("weight").alias("score"))
        .join(F.broadcast(totals), "kind")
        .withColumn("p", 1 / (1 + F.exp(-(F.col("score") + F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))))))
        .where(F.col("p") >= ACCEPT)
        .select("span.row", "kind", "span.start", "span.end")
    )
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    firm = spans.where("kind is null or base").select("row", "id", F.when(F.col("kind").isNotNull(), span).alias("span"), F.lit(True).alias("base"))
    added = scored.select("row", F.lit(None).cast(base.schema["id"].dataType).alias("id"), span.alias("span"), F.lit(False).alias("base"))
    out = firm.unionByName(added).groupBy("row").agg(
        F.max("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base_spans"), F.array_sort(F.collect_list("span")).alias("spans")
    )
    return out.select(F.col("id").alias(id_col), *[F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(c) for c in ("base_spans", "spans")])
