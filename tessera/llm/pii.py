"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from strict patterns (the base kinds) and from wider ones: obfuscated mail addresses, local
telephone numbers, long-form network addresses, and number runs whose check digit fails. Five labelers vote on each
candidate (-1, 0 or 1): form, check digits and ranges, a gazetteer of known endings, prefixes and codes, words before
the span, and what touches it. Expectation-maximisation over the counts of vote patterns (some thousands at most, at
any size of the corpus) estimates how reliable each labeler is, without labels; the posteriors train a logistic span
classifier over votes, kind and length. Base spans always stay; a wider candidate is added if the classifier gives it
at least ACCEPT and it overlaps no base span.

Matches are found with split and regexp_extract_all: their places follow from the lengths of the pieces between them.
Mail addresses are found from their @: what may stand before it and after it are single runs of characters, which no
length of text can bring the matcher to its limits with.

Defined cases: null and empty texts have no spans; repeated rows get equal results, and rows of one doc_id with different
texts, or without doc_id, each their own; ties between kinds go in the order of KINDS; very long texts are searched whole;
an empty table gives no rows. Other columns are ignored by personal_data and passed on by redact, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, write_table

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.9
CONTEXT = 40

# Fixed patterns of the base kinds. Possessive runs and look-behind keep long runs linear without changing what is found:
# of a run of digits or address characters only its start, or the end of the match before, can begin a match. Card and
# phone patterns count digits in the pattern; their runs are maximal, so those that fail are left out as a whole.
BASE = {
    "ip": r"[0-9]++(?:\.[0-9]+){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*[0-9]){8,14}(?![\x20().-]*[0-9])",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,126}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Before and after the @ of a mail address: the last run of the one, the first run of the other.
LOCAL, DOMAIN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\z", r"\A[A-Za-z0-9-][A-Za-z0-9.-]*+"
#: A text without these characters has no match.
NEEDS = {"ip": ".", "card": None, "phone": "+"}
#: Matches that are put in a row together.
BLOCK = 512
#: Every obfuscated mail address has one of these.
DOT = r"\[dot\]|\(dot\)|\x20dot\x20"

# Fixed word lists of the gazetteer and context labelers.
#: Generic endings of host names; any two letters are a country's.
ENDINGS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "online", "shop", "site", "store", "tech", "cloud", "blog", "agency", "email", "company", "solutions", "services", "news", "media", "academy", "berlin", "london", "paris", "swiss", "example"]
CARD_PREFIX = r"^(4|5[0-8]|2[2-7]|3[4-9]|6[0-9]|30|9792)"
#: Country calling codes of one, two and three digits.
PHONE_PREFIX = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|80[08]|85[02356]|870|88[0-368]|96[0-8]|97[0-79]|99[2-68])"
CUES = {
    "email": r"\b(e-?mails?|mail|mailto|contact|reach|write to|reply|address|from|cc|bcc|correo|courriel|kontakt|adresse|schreiben|escriba|écrire|contacto|contatto|posta)\b",
    "ip": r"\b(ips?|ipv4|ipv6|host|server|address|addr|gateway|dns|subnet|proxy|login|from|client|remote|adresse|dirección|servidor|serveur)\b",
    "card": r"\b(cards?|visa|mastercard|maestro|amex|discover|credit|debit|payment|paid|billing|carte|karte|kreditkarte|tarjeta|carta|account|konto|cuenta|compte)\b",
    "phone": r"\b(phones?|tel|telephone|call|called|calls|dial|ring|text|sms|whatsapp|mobile|fax|cell|hotline|contact|reach|telefon|handy|anrufen|téléphone|appeler|appelez|teléfono|llame|móvil|telefono|chiama)\b",
}
AGAINST = r"(\b(version|isbn|issn|doi|id|no|nr|order|sku|serial|rev|build|ticket|invoice|part|model|page|chapter|section)\b[.:#\x20]*|[=/_#\"'])$"
EMPTY = "cast(array() as array<struct<start:int,end:int,found:string,before:string,after:string>>)"


def in_a_row(n: Column, start: Column, step) -> Column:
    """What step(acc, k) puts into acc.out for k from 0 to n - 1, in blocks, so that long results aren't copied for each of their parts."""

    def block(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1), F.struct(acc["at"].alias("at"), F.expr(EMPTY).alias("out")), step)
        return F.get(F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), F.lit(0))

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    none = F.expr(f"cast(array() as array<{EMPTY.split(' as ')[1][:-1]}>)")
    return F.when(n > 0, F.aggregate(blocks, F.struct(start.alias("at"), none.alias("out")), block, lambda acc: F.flatten(acc["out"]))).otherwise(F.expr(EMPTY))


def one(start: Column, end: Column, found: Column, before: Column, after: Column) -> Column:
    """A match with what stands around it, taken from the pieces between matches: the whole text need not go along with each."""
    return F.array(F.struct(start.alias("start"), end.alias("end"), found.alias("found"), F.lower(F.right(before, F.lit(CONTEXT))).alias("before"), F.left(after, F.lit(1)).alias("after")))


def piece(pieces: Column, k: Column) -> Column:
    return F.coalesce(F.get(pieces, k), F.lit(""))


def spans(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (start, end, found) of all matches, in code points."""

    def step(both: Column):
        def add(acc: Column, k: Column) -> Column:
            parts, every, found = both["parts"], both["found"], F.get(both["found"], k)
            start = acc["at"] + F.length(F.get(parts, k))
            end = start + F.length(found)
            before, after = F.concat(piece(parts, k - 1), piece(every, k - 1), piece(parts, k)), F.concat(piece(parts, k + 1), piece(every, k + 1))
            return F.struct(end.alias("at"), F.concat(acc["out"], one(start, end, found, before, after)).alias("out"))

        return add

    cut = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    every = F.get(F.transform(F.array(cut), lambda both: in_a_row(F.size(both["found"]), F.lit(0), step(both))), F.lit(0))
    return F.when(possible, F.coalesce(every, F.expr(EMPTY))).otherwise(F.expr(EMPTY))


def addresses(text: Column) -> Column:
    """Array of (start, end, found) of mail addresses: one for each @ with the right runs around it, never before the end of the last."""

    def step(parts: Column):
        def add(acc: Column, k: Column) -> Column:
            at, before = acc["at"]["sign"] + F.length(F.get(parts, k)), F.get(parts, k)
            domain = F.rtrim(F.substring_index(F.regexp_extract(F.get(parts, k + 1), DOMAIN, 0), "..", 1), F.lit("."))
            local = F.regexp_extract(before, LOCAL, 0)
            own = F.struct(at.alias("sign"), F.greatest(at - F.length(local), acc["at"]["end"]).alias("start"), local.alias("local"), domain.alias("domain"))

            def tell(x: Column) -> Column:
                end = x["sign"] + 1 + F.length(x["domain"])
                found = F.concat(F.right(x["local"], x["sign"] - x["start"]), F.lit("@"), x["domain"])
                there = x["domain"].contains(".") & (x["start"] < x["sign"])
                last = F.length(F.get(parts, k)) - F.length(x["local"])
                earlier = F.concat(piece(parts, k - 1), F.when(k > 0, F.lit("@")).otherwise(F.lit("")), F.left(F.get(parts, k), last))
                later = F.substring(F.get(parts, k + 1), F.length(x["domain"]) + 1, F.lit(1))
                now = F.struct((x["sign"] + 1).alias("sign"), F.when(there, end).otherwise(acc["at"]["end"]).alias("end"))
                return F.struct(now.alias("at"), F.when(there, F.concat(acc["out"], one(x["start"], end, found, earlier, later))).otherwise(acc["out"]).alias("out"))

            return F.get(F.transform(F.array(own), tell), F.lit(0))

        return add

    start = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("end"))
    every = F.get(F.transform(F.array(F.split(text, "@", -1)), lambda parts: in_a_row(F.size(parts) - 1, start, step(parts))), F.lit(0))
    return F.when(text.contains("@"), every).otherwise(F.expr(EMPTY))


def luhn(found: Column) -> Column:
    """Whether the check digit of a run of digits is right."""
    digits = F.reverse(F.regexp_replace(found, "[^0-9]", ""))

    def value(k: Column) -> Column:
        d = F.substring(digits, k + 1, F.lit(1)).cast("int") * (1 + k % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, k: s + value(k)) % 10 == 0


def labelled(kind: str, wide: bool):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), F.lit(wide).alias("wide"), s["before"].alias("before"), s["after"].alias("after"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, rid (a hash of id and text), kind, start, end, found, wide, before, after for each candidate of id_and_text rows."""
    text = F.col("text")
    digits = text.rlike("[0-9]")
    lists = [F.transform(addresses(text), labelled("email", False))]
    for wide, patterns in ((False, BASE), (True, WIDE)):
        for kind, pattern in patterns.items():
            need = text.contains(NEEDS[kind]) if not wide and NEEDS[kind] else None
            possible = {("email", True): text.rlike(DOT), ("ip", True): digits & text.contains(":")}.get((kind, wide), digits if need is None else digits & need)
            lists.append(F.transform(spans(text, pattern, possible), labelled(kind, wide)))
    some = docs.where(digits | text.contains("@") | text.rlike(DOT))
    return some.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.explode(F.concat(*lists)).alias("c")).select("doc_id", "rid", "c.*")


def valid(kind: Column, found: Column) -> Column:
    """Ranges of the parts of an address, and the check digit."""
    parts = F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "ip", parts).when(kind == "card", luhn(found)).otherwise(F.lit(True))


def votes(rows: DataFrame) -> DataFrame:
    """rows with base and the labelers' votes v0 to v4."""
    kind, found = F.col("kind"), F.col("found")
    digits = F.regexp_replace(found, "[^0-9]", "")
    sound = F.when(F.col("wide"), F.lit(None).cast("boolean")).otherwise(valid(kind, found))
    ending = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
    known = F.when(kind == "email", ending.isin(ENDINGS) | ending.rlike("^[a-z]{2}$")).when(kind == "card", digits.rlike(CARD_PREFIX)).when(kind == "phone", F.when(found.startswith("+"), found.rlike(PHONE_PREFIX)))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & F.col("before").rlike(words))

    def vote(yes: Column) -> Column:
        return F.when(yes, 1).when(~yes, -1).otherwise(0)

    touches = F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]") | F.col("before").rlike(AGAINST)
    return rows.select(
        "*",
        (~F.col("wide") & valid(kind, found)).alias("base"),
        F.when(F.col("wide"), 0).otherwise(1).alias("v0"),
        vote(sound).alias("v1"),
        vote(known).alias("v2"),
        F.when(cue, 1).otherwise(0).alias("v3"),
        F.when(touches, -1).otherwise(0).alias("v4"),
        F.least(F.length("found") / 8, F.lit(3)).cast("int").alias("long"),
    )


LABELERS = ["v0", "v1", "v2", "v3", "v4"]


def estimate(patterns: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 30) -> tuple[list[dict[int, tuple[float, float]]], list[float]]:
    """EM over (kind, votes, length class, count): P(vote | not personal, personal) of each labeler, and the posterior of each pattern."""
    post = [1 / (1 + math.exp(-sum(v))) for _, v, _, _ in patterns]
    tables: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        weight = [sum(n * (1 - p) for (_, _, _, n), p in zip(patterns, post, strict=True)), sum(n * p for (_, _, _, n), p in zip(patterns, post, strict=True))]
        prior = [(w + 1) / (sum(weight) + 2) for w in weight]
        tables = []
        for j in range(len(LABELERS)):
            table = {}
            for value in (-1, 0, 1):
                yes = sum(n * p for (_, v, _, n), p in zip(patterns, post, strict=True) if v[j] == value)
                no = sum(n * (1 - p) for (_, v, _, n), p in zip(patterns, post, strict=True) if v[j] == value)
                table[value] = ((no + 1) / (weight[0] + 3), (yes + 1) / (weight[1] + 3))
            tables.append(table)
        post = []
        for _, v, _, _ in patterns:
            odds = math.log(prior[1] / prior[0]) + sum(math.log(tables[j][x][1] / tables[j][x][0]) for j, x in enumerate(v))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return tables, post


def inputs(kind: str, v: tuple[int, ...], length: int) -> list[float]:
    return [1.0, *map(float, v), *[float(kind == k) for k in KINDS], length / 3]


def train(patterns: list[tuple[str, tuple[int, ...], int, int]], post: list[float], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression on the posteriors, each pattern weighted by its share."""
    rows = [(inputs(k, v, m), p, n) for (k, v, m, n), p in zip(patterns, post, strict=True)]
    total = sum(n for _, _, n in rows) or 1
    weights = [0.0] * len(inputs(KINDS[0], (0,) * len(LABELERS), 0))
    for _ in range(steps):
        slope = [decay * w for w in weights]
        for x, p, n in rows:
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - p) * n / total
            for i, a in enumerate(x):
                slope[i] += miss * a
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def probability(weights: list[float]) -> Column:
    out = F.lit(weights[0])
    for w, c in zip(weights[1 : 1 + len(LABELERS)], LABELERS, strict=True):
        out = out + w * F.col(c)
    for w, k in zip(weights[1 + len(LABELERS) :], KINDS, strict=False):
        out = out + F.when(F.col("kind") == k, w).otherwise(0.0)
    return 1 / (1 + F.exp(-(out + weights[-1] * F.col("long") / 3)))


def personal_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, rid, kind, start, end, found, base, probability: base spans and those that the classifier adds. Spans of rows with equal ids and texts are told once."""
    rows = write_table(votes(candidates(id_and_text(docs))).distinct(), "candidates")
    counts = rows.groupBy("kind", *LABELERS, "long").agg(F.count("*").alias("n")).collect()  # a row for each pattern of votes
    patterns = sorted((r.kind, tuple(r[v] for v in LABELERS), r.long, r.n) for r in counts)
    _, post = estimate(patterns)
    scored = rows.withColumn("probability", probability(train(patterns, post)))
    span = Window.partitionBy("rid").orderBy("start")
    upto, on = span.rowsBetween(Window.unboundedPreceding, 0), span.rowsBetween(0, Window.unboundedFollowing)
    beside = (F.max(F.when(F.col("base"), F.col("end"))).over(upto) > F.col("start")) | (F.min(F.when(F.col("base"), F.col("start"))).over(on) < F.col("end"))
    own = scored.where(F.col("base") | (F.col("probability") >= accept)).withColumn("beside", F.coalesce(beside, F.lit(False)))
    return own.where("base or not beside").select("doc_id", "rid", "kind", "start", "end", "found", "base", "probability")


def grouped_spans(docs: DataFrame, accept: float) -> DataFrame:
    """rid, base and spans (sorted arrays of place, kind number, end) of the texts that have any."""
    found = personal_spans(docs, accept)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), order.alias("kind"), F.col("end"))
    return found.groupBy("rid").agg(F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans"))


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and spans (sorted arrays of place, kind number, end) for each row of docs."""
    rows = id_and_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("rid"))
    return rows.join(grouped_spans(docs, accept), "rid", "left").select("doc_id", "base", "spans")


def text_of(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"] - 1), s["start"], s["end"]))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """docs with [KIND] in the place of each span; of overlapping spans the first counts."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))  # names of docs can't meet those used here
    own = own.select("own", F.xxhash64(F.col("own.doc_id").cast("long"), F.col("own.text").cast("string")).alias("rid"))
    joined = own.join(grouped_spans(docs, accept), "rid", "left").select("own", F.col("own.text").alias("text"), "spans")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        pieces = F.concat(acc["out"], F.array(F.struct(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]).alias("kept"), F.get(label, s["kind"] - 1).alias("label"))))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), pieces.alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<kept:string,label:string>>)").alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(F.transform(acc["out"], lambda x: F.concat(x["kept"], x["label"])), ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    told = joined.select("own", F.coalesce(done, F.col("text")).alias("text"))
    return told.select(*[F.col("text").alias("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
