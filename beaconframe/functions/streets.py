"""Street names as heard over the radio: likeness of two names, and keys that find every pair that is alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DIRECTIONS, canonical_street

# The least score that counts, each rule's score, types, and words never taken for each other.
LEAST = 0.72
SAME_SKELETON, NEAR_SKELETON, SAME_SINGLED, OTHER_VOWEL, EDITS, EDITS_MORE = 0.88, 0.78, 0.82, 0.80, 0.68, 0.20
TYPES = ("RD", "ST", "AVE", "DR", "LN", "CT", "BLVD", "PL", "WAY", "TRL", "HWY", "PKWY", "CIR", "TERR")
NEVER = (("CREEK", "COURT"),)


def rest(s: Column, start: int) -> Column:
    return F.substr(s, F.lit(start))


def head(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def skeleton(core: Column) -> Column:
    """The first letter and the consonants after it; one that follows itself, vowels aside, stays once."""
    letters = F.regexp_replace(F.upper(core), "[^A-Z]", "")
    return F.regexp_replace(F.concat(head(letters, 1), F.regexp_replace(rest(letters, 2), "[AEIOUY]", "")), r"(.)\1+", "$1")


def singled(s: Column) -> Column:
    """The string, and it without one of each two equal neighbours."""
    at = F.when(F.length(s) > 1, F.sequence(F.lit(1), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))
    shorter = F.transform(at, lambda i: F.when(F.substr(s, i, F.lit(1)) == F.substr(s, i + 1, F.lit(1)), F.concat(F.left(s, i), F.substr(s, i + 2))))
    return F.array_distinct(F.array_compact(F.concat(F.array(s), shorter)))


def edit_limit(a: Column, b: Column) -> Column:
    """How many edits two street cores may be apart: by their lengths and the letters they begin with alike."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    same = lambda n: head(a, n) == head(b, n)
    even = long - short <= 1
    return F.when(long >= 7, F.when((short >= 4) & same(4), 3).otherwise(2)).when((short >= 5) & even & same(2), 2).when((short >= 4) & even & same(1), 2).otherwise(1)


def score(a: Column, b: Column) -> Column:
    """0 to 1: how likely two street cores (upper case, without blanks) are one name misheard; 0 below 0.72.

    Equal cores have 1, cores with digits are never alike otherwise.  A phonetic
    key is the skeleton of a core or of a singled form of it; since a skeleton
    holds no repeats, these are one, and equal keys are equal skeletons.
    """
    la, lb = F.length(a), F.length(b)
    short, long, apart = F.least(la, lb), F.greatest(la, lb), F.abs(la - lb)
    sa, sb = skeleton(a), skeleton(b)
    d, limit, sd = F.levenshtein(a, b), edit_limit(a, b), F.levenshtein(sa, sb)
    first, second = head(a, 1) == head(b, 1), head(a, 2) == head(b, 2)
    near = F.exists(singled(a), lambda v: F.exists(singled(b), lambda w: ((v != a) | (w != b)) & (F.greatest(F.length(v), F.length(w)) <= 5) & (F.abs(F.length(v) - F.length(w)) <= 1) & (F.levenshtein(v, w) <= 2)))
    homophone = first & (apart <= 2) & (F.arrays_overlap(singled(a), singled(b)) | ((long <= 6) & near))
    same_skeleton = (sa == sb) & (F.length(sa) >= 2)
    near_skeleton = (long <= 5) & ((short < 5) | second) & (F.least(F.length(sa), F.length(sb)) >= 3) & (sd <= 1)
    sounds = (sa == sb) | ((head(sa, 2) == head(sb, 2)) & (F.least(F.length(sa), F.length(sb)) >= 2) & (sd <= F.when(d >= 3, 2).otherwise(1)))
    edited = (apart <= 2) & (d <= limit) & first & ((d <= 1) | second) & ((d < 2) | (la < 6) | sounds)
    vowel = lambda x: x.rlike("^[AEIOUY]")
    onset = (apart <= 2) & vowel(a) & vowel(b) & ~first & (short >= 6) & (F.levenshtein(rest(a, 2), rest(b, 2)) <= 1)
    best = F.greatest(
        F.when(homophone, SAME_SINGLED).otherwise(0.0),
        F.when(same_skeleton, SAME_SKELETON).when(near_skeleton, NEAR_SKELETON).otherwise(0.0),
        F.when(edited, EDITS + EDITS_MORE * (limit - d + 1) / (limit + 1)).otherwise(0.0),
        F.when(onset, OTHER_VOWEL).otherwise(0.0),
    )
    never = F.array(a, b).isin(*[F.array(F.lit(x), F.lit(y)) for pair in NEVER for x, y in (pair, pair[::-1])])
    blank = (la == 0) | (lb == 0)
    return F.when(blank, 0.0).when(a == b, 1.0).when(a.rlike("[0-9]") | b.rlike("[0-9]") | never | (best < LEAST), 0.0).otherwise(best)


def parts(name: Column) -> Column:
    """Direction, core, type and the core's sorted words of a street name; a direction or type that is all there is, is the name."""
    words = F.split(canonical_street(name), " ")
    last = lambda w: F.element_at(w, -1)
    fewer = lambda w: F.slice(w, 1, F.size(w) - 1)

    def drop(w: Column, when: Column, to: Column) -> Column:
        return F.when(when, to).otherwise(w)

    def named(w: Column) -> Column:
        return F.exists(w, lambda x: ~x.isin(*DIRECTIONS, *TYPES))

    start = F.struct(words.alias("w"))
    # One pass each, so that no expression is written out again for every later use.
    step = lambda of, f: F.get(F.transform(F.array(of), f), F.lit(0))
    tailed = step(start, lambda s: F.struct(drop(s["w"], (F.size(s["w"]) > 2) & last(s["w"]).isin(*DIRECTIONS), fewer(s["w"])).alias("w"), F.when((F.size(s["w"]) > 2) & last(s["w"]).isin(*DIRECTIONS), last(s["w"])).alias("tail")))
    typed = step(tailed, lambda s: F.struct(drop(s["w"], (F.size(s["w"]) > 1) & last(s["w"]).isin(*TYPES), fewer(s["w"])).alias("w"), s["tail"].alias("tail"), F.when((F.size(s["w"]) > 1) & last(s["w"]).isin(*TYPES), last(s["w"])).alias("type")))
    leads = lambda s: (F.size(s["w"]) > 1) & F.get(s["w"], F.lit(0)).isin(*DIRECTIONS) & named(F.slice(s["w"], 2, 1000))
    return step(
        typed,
        lambda s: F.struct(
            F.when(leads(s), F.get(s["w"], F.lit(0))).alias("direction"),
            F.array_join(drop(s["w"], leads(s), F.slice(s["w"], 2, 1000)), "").alias("core"),
            s["type"].alias("type"),
            F.array_join(F.array_sort(drop(s["w"], leads(s), F.slice(s["w"], 2, 1000))), " ").alias("sorted"),
        ),
    )


def alike(a: Column, b: Column) -> Column:
    """Whether two street names are one misheard: as wholes, or word by word where both have as many words."""
    strip = lambda c: F.filter(F.split(canonical_street(c), " "), lambda w: ~w.isin(*TYPES))
    both = F.struct(parts(a).alias("p"), parts(b).alias("q"), strip(a).alias("x"), strip(b).alias("y"))

    def test(t: Column) -> Column:
        agree = lambda n: F.coalesce(t["p"][n] == t["q"][n], F.lit(True))
        whole = F.exists(F.array(t), lambda u: score(u["p"]["core"], u["q"]["core"]) > 0) | ((t["p"]["sorted"] == t["q"]["sorted"]) & F.contains(t["p"]["sorted"], F.lit(" ")))
        each = (F.size(t["x"]) == F.size(t["y"])) & (F.size(t["x"]) > 0) & F.forall(F.zip_with(t["x"], t["y"], lambda x, y: score(x, y) > 0), lambda hit: hit)
        return agree("type") & ((agree("direction") & whole) | each)

    return F.exists(F.array(both), test)  # a loop of one turn, so that the parts are worked out once


def without(s: Column, times: int = 1) -> Column:
    """The string and all that is left of it without up to ``times`` of its characters."""
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    once = F.concat(F.array(s), F.transform(at, lambda i: F.concat(F.left(s, i - 1), F.substr(s, i + 1))))
    return F.array_distinct(once if times == 1 else F.flatten(F.transform(once, lambda x: without(x, times - 1))))


def match_keys(core: Column, in_order: Column) -> Column:
    """Keys of a core such that two cores of a score of 0.72 or more, or with the same words, share one.

    Two strings at most n edits apart become equal without up to n characters of
    each, so every rule that allows n edits has keys of that kind, behind the
    letters that the rule asks to be alike.
    """
    n, bones = F.length(core), skeleton(core)
    none = F.array().cast("array<string>")
    some = lambda when, keys: F.when(when, keys).otherwise(none)
    tag = lambda mark, keys: F.transform(keys, lambda k: F.concat(F.lit(mark), k))
    with_head = lambda mark, s, k, times: F.transform(without(rest(s, k + 1), times), lambda x: F.concat(F.lit(mark), head(s, k), F.lit("-"), x))
    fuzzy = F.concat(
        some(F.length(bones) >= 2, tag("s", F.array(bones))),
        tag("v", singled(core)),
        some(n <= 6, F.flatten(F.transform(F.filter(singled(core), lambda v: F.length(v) <= 5), lambda v: with_head("d", v, 1, 2)))),
        with_head("1", core, 1, 1),
        with_head("2", core, 2, 2),
        some(n >= 5, tag("4", F.array(head(core, 4)))),
        some((n >= 6) & core.rlike("^[AEIOUY]"), tag("w", without(rest(core, 2)))),
        some((n <= 5) & (F.length(bones) >= 3), tag("k", without(bones))),
    )
    exact = F.concat(tag("=", F.array(core)), some(F.contains(in_order, F.lit(" ")), tag("t", F.array(in_order))))
    return F.array_distinct(F.concat(exact, some(~core.rlike("[0-9]") & (n > 0), fuzzy)))


def best_matches(heard: DataFrame, known: DataFrame) -> DataFrame:
    """(said, street, score): the known street that each heard name most likely is, none where none is close enough.

    ``heard`` has a column said, ``known`` a column street.  Types and directions
    agree where both names have one; the same core, or its words in another order,
    scores 1; a core that is known is never taken for another one.  Ties go to the
    least street.  Null and empty names match nothing; repeated ones count once.
    """
    side = lambda t, name: t.where(F.trim(name) != "").select(name).distinct().withColumn("p", parts(F.col(name)))
    keyed = lambda t, p: t.withColumn("key", F.explode(match_keys(F.col(p)["core"], F.col(p)["sorted"])))
    right = side(known, "street").withColumnRenamed("p", "q")
    cores = right.select(F.col("q.core").alias("core"), F.lit(True).alias("exists")).distinct()
    left = side(heard, "said").join(cores, F.col("p.core") == F.col("core"), "left").drop("core")
    pairs = keyed(left, "p").join(keyed(right, "q"), "key").drop("key").distinct()
    agree = lambda n: F.coalesce(F.col("p")[n] == F.col("q")[n], F.lit(True))
    same_words = (F.col("p.sorted") == F.col("q.sorted")) & F.contains(F.col("p.sorted"), F.lit(" "))
    by_sound = F.when(F.col("exists").isNull(), score(F.col("p.core"), F.col("q.core"))).otherwise(0.0)
    scored = pairs.where(agree("type") & agree("direction")).withColumn("score", F.when((F.col("p.core") == F.col("q.core")) | same_words, 1.0).otherwise(by_sound))
    first = F.min(F.struct((-F.col("score")).alias("s"), "street"))
    return scored.where(F.col("score") >= LEAST).groupBy("said").agg(first.alias("m")).select("said", "m.street", (-F.col("m.s")).alias("score"))
