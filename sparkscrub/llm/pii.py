"""Personal data: fixed seed patterns, then bootstrapped contextual extraction. Native throughout.

1. Seeds: e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers, which
   are the base spans, and strings that have the form of a secret (long hexadecimal runs, known prefixes).
2. Instances: the seeds, and identifier-shaped strings that no seed pattern accepts (a number that fails a
   check, an address without a domain, a quoted value that is assigned), which are unknown.
3. Lexical patterns: for each occurrence of an instance, the word left of it, the two words left, the word
   right, and the words on both sides, each with the instance's kind.
4. The pattern-instance graph is scored in rounds until nothing changes: a pattern's confidence is the
   lower bound of the mean score of its instances (few instances prove little), an instance's score the
   best confidence of its patterns. Patterns with enough accepted instances and enough confidence accept
   their unknown instances, which support further patterns in the next round. Seeds keep score 1.
5. Every occurrence of an accepted instance is a span. Base spans are never changed or dropped, and what
   overlaps with one is no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscrub.llm.spans import match_spans
from sparkscrub.llm.staging import stage

#: Fixed: kinds of base spans in the order in which spans are listed; further spans may also be secrets.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Fixed seed patterns. Look-behinds and possessive quantifiers only skip starts that cannot match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![0-9A-Za-z])(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"
#: Identifier-shaped strings, valid or not: numbers have 7 to 19 digits, assigned values 6 characters or more.
LOOSE_AT = r"(?<![^\s@,;<>\x22()])[^\s@,;<>\x22()]++@[^\s@,;<>\x22()]++"
LOOSE_IP = r"(?<![0-9A-Fa-f.:])[0-9A-Fa-f]{1,4}+(?:[.:][0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Fa-f])"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]?[0-9]){6,18}+(?![0-9A-Za-z])"
LOOSE_VALUE = r"(?<=[=:]\x20{0,1}[\x22'])[^\s\x22']{6,}+(?=[\x22'])"

MIN_SEEDS, MIN_CONFIDENCE, DEVIATIONS = 5, 0.7, 3.0
#: Code points on each side of an instance in which the words of its patterns are looked for.
AROUND = 80


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(c)), ""), lambda x: F.expr("0") + F.ascii(x) - 48)
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda s, x: s + x) % 10 == 0


def _octets(c: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(c, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.left(part(x), F.lit(3)).cast("int") <= 255))


def base_spans(text: Column, around: int = AROUND) -> dict[str, Column]:
    """Per kind, the array of (start, end, value, left, right) of its valid matches."""
    n = lambda s: F.length(_digits(s["value"]))
    return {
        "email": match_spans(text, EMAIL, "@[A-Za-z0-9-]", around),
        "ip": F.filter(match_spans(text, IP, r"[0-9]\.[0-9]++\.[0-9]", around), lambda s: _octets(s["value"])),
        "card": F.filter(match_spans(text, CARD, r"[0-9](?:[\x20-]?[0-9]){12}", around), lambda s: F.when(n(s).between(13, 19), _luhn(s["value"])).otherwise(False)),
        "phone": F.filter(match_spans(text, PHONE, r"\+[0-9]", around), lambda s: n(s).between(9, 15)),
    }


def _loose_spans(text: Column, around: int) -> list[tuple[Column, Column | str, bool]]:
    """(spans, kind, seed) of what is not base: secrets by form, and unknown instances."""
    number_kind = lambda s: F.when(F.length(_digits(s["value"])) >= 12, "card").otherwise("phone")
    values = match_spans(text, LOOSE_VALUE, r"[=:]\x20?[\x22'][^\s\x22']", around)
    return [
        (match_spans(text, SECRET, "[0-9A-Fa-f]{32}|AKIA|gh[a-z]_", around), "secret", True),
        (match_spans(text, LOOSE_AT, "@", around), "email", False),
        (match_spans(text, LOOSE_IP, r"[0-9A-Fa-f][.:][0-9A-Fa-f]++[.:]", around), "ip", False),
        (match_spans(text, LOOSE_NUMBER, r"[0-9](?:[\x20().-]?[0-9]){6}", around), number_kind, False),
        (F.filter(values, lambda s: ~s["value"].rlike(SECRET)), "secret", False),
    ]


def _patterns(left: Column, right: Column) -> Column:
    """Distinct lexical patterns of an occurrence; words are lower case, digits are ``#``."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[0-9]", "#"))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(plain(left), r"[\s\x22'(:=]+$", ""), r"\s+", " ")), " ")
    after = F.regexp_replace(F.regexp_extract(plain(right), r"^[\s\x22'),.;:!?]*([^\s]+)", 1), r"[\x22'),.;:!?]+$", "")

    def made(w: Column) -> Column:
        one, two = F.element_at(w, -1), F.concat_ws(" ", F.slice(w, -2, F.lit(2)))
        return F.array(
            F.when(one != "", F.concat(F.lit("l "), one)), F.when((F.size(w) > 1), F.concat(F.lit("ll "), two)),
            F.when(after != "", F.concat(F.lit("r "), after)), F.when((one != "") & (after != ""), F.concat(F.lit("lr "), one, F.lit(" "), after)),
        )

    # slice from -2 needs two elements
    return F.array_compact(F.transform(F.array(words), lambda w: made(F.when(F.size(w) > 1, w).otherwise(F.concat(F.array(F.lit("")), w))))[0])


def _typed(spans: Column, kind: Column | str, seed: bool, base: bool) -> Column:
    of = (lambda s: F.lit(kind)) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.struct(
        of(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"),
        F.lit(seed).alias("seed"), F.lit(base).alias("base"), s["left"].alias("left"), s["right"].alias("right"),
    ))


def _apart(spans: DataFrame) -> DataFrame:
    """Spans (row, start, end, base, ...) that overlap with no base span of their row, and base spans; two sorted passes."""
    up = Window.partitionBy("row").orderBy("start", F.col("base").desc()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.col("start").desc(), "base").rowsBetween(Window.unboundedPreceding, -1)
    ends, starts = F.max(F.when(F.col("base"), F.col("end"))).over(up), F.min(F.when(F.col("base"), F.col("start"))).over(down)
    marked = spans.withColumn("__end", ends).withColumn("__start", starts)
    clear = (F.coalesce("__end", F.lit(0)) <= F.col("start")) & (F.coalesce("__start", F.col("end")) >= F.col("end"))
    return marked.where(F.col("base") | clear).drop("__end", "__start")


def confidence(score: Column, n: Column, deviations: float) -> Column:
    """Lower end of the score interval (Wilson) of a share ``score / n`` at so many deviations."""
    p, z = score / n, F.lit(float(deviations))
    low = p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return low / (1 + z * z / n)


def _accepted(graph: DataFrame, rounds: int | None, min_seeds: int, min_confidence: float, deviations: float) -> DataFrame:
    """(kind, value, score) of the accepted instances of a staged graph (kind, pattern, value, seed)."""
    known = stage(graph.where("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct(), "pii-accepted")
    done = 0
    while rounds is None or done < rounds:
        weighed = graph.join(known, ["kind", "value"], "left")
        sums = weighed.groupBy("kind", "pattern").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.count("score").alias("k"), F.count(F.lit(1)).alias("n"))
        good = sums.where(F.col("k") >= min_seeds).withColumn("confidence", confidence(F.col("s"), F.col("n"), deviations)).where(F.col("confidence") >= min_confidence)
        new = graph.join(good.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("confidence").alias("score"))
        new = stage(new.join(known, ["kind", "value"], "left_anti"), "pii-new")
        if new.isEmpty():
            break
        known, done = stage(known.unionByName(new), "pii-accepted"), done + 1
    return known


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None,
    min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, deviations: float = DEVIATIONS, around: int = AROUND,
) -> DataFrame:
    """One row per row of ``docs``: id, base and found, arrays of (kind, start, end, value).

    ``base`` holds the base spans, ``found`` the further identifiers (seeds of kind secret, and discovered
    ones of any kind). ``rounds`` None: until a round accepts nothing. Null text counts as empty and has no
    span. Repeated rows each get a row. Other columns of ``docs`` are not read, whatever their names. An
    empty table gives an empty result. Long texts cost in proportion to their length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    seeds = F.concat(*[_typed(spans, kind, True, True) for kind, spans in base_spans(text, around).items()])
    loose = F.concat(*[_typed(spans, kind, seed, False) for spans, kind, seed in _loose_spans(text, around)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias(id_col), seeds.alias("base"), loose.alias("loose"))
    rows = stage(rows, "pii-rows")
    spans = rows.where("size(base) > 0 or size(loose) > 0").select("row", F.explode(F.concat("base", "loose")).alias("s")).select("row", "s.*")
    spans = _apart(spans).select("row", "kind", "start", "end", "value", "seed", "base", _patterns(F.col("left"), F.col("right")).alias("patterns"))
    spans = stage(spans, "pii-spans")
    graph = spans.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    # a pattern without unknown instances names nothing
    open_ = graph.groupBy("kind", "pattern").agg(F.bool_or(~F.col("seed")).alias("open")).where("open").select("kind", "pattern")
    graph = stage(graph.join(open_, ["kind", "pattern"]), "pii-graph")
    accepted = _accepted(graph, rounds, min_seeds, min_confidence, deviations).select("kind", "value")
    unknown = spans.where("not base and not seed").join(accepted, ["kind", "value"], "left_semi").select("row", "kind", "start", "end", "value")
    new = spans.where("not base and seed").select("row", "kind", "start", "end", "value").unionByName(unknown)
    new = new.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("found"))
    plain = "array<struct<kind:string,start:int,end:int,value:string>>"
    short = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.join(new, "row", "left").select(id_col, short("base").alias("base"), F.coalesce("found", F.array().cast(plain)).alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed in ALL_KINDS, then start, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
