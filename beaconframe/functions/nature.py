"""Incident labels from transcripts: evidence scores of phrases, overrides and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN PROBLEM"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "), " "), lambda t: t != "")


def stem_equal(a: Column, b: Column) -> Column:
    """Long words that agree in their first five letters or more and end differently in three letters at most."""
    shared = F.aggregate(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)), i).otherwise(n))
    both_ly = F.endswith(a, F.lit("LY")) == F.endswith(b, F.lit("LY"))
    suffix = lambda x: F.substr(x, shared + 1).isin("", "S", "ES", "ED", "ING", "ER", "ERS", "ION", "LY", "E")
    return (F.length(a) >= 5) & (F.length(b) >= 5) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5))) & (shared >= 5) & (F.length(a) - shared <= 3) & (F.length(b) - shared <= 3) & both_ly & suffix(a) & suffix(b)


def term_matches(token: Column, term: Column, following: Column) -> Column:
    """Equal, one the other's plural, or of one stem; a lone -ING before OUT, AROUND, BACK or UP does not count."""
    plural = (token == F.concat(term, F.lit("S"))) | (token == F.concat(term, F.lit("ES"))) | (term == F.concat(token, F.lit("S"))) | (term == F.concat(token, F.lit("ES")))
    phrasal = F.endswith(token, F.lit("ING")) & F.coalesce(following.isin("OUT", "AROUND", "BACK", "UP"), F.lit(False))
    return (token == term) | ((plural | stem_equal(token, term)) & ~phrasal)


def evidence(transcripts: DataFrame, phrases: DataFrame) -> DataFrame:
    """call_id, label, score: distinct tokens that the label's phrases cover, and one more if a phrase of several words is among them.

    ``transcripts``: call_id, transcript; ``phrases``: label, phrase (a short
    list, whose size is checked before it is broadcast).
    """
    listed = phrases.select("label", tokens(F.col("phrase")).alias("terms")).where("size(terms) > 0")
    size = listed.agg(F.count(F.lit(1)).alias("phrases"), F.coalesce(F.max(F.size("terms")), F.lit(1)).alias("longest")).collect()[0]
    listed = F.broadcast(listed) if size.phrases <= 5_000 else listed
    # Each token goes with the few after it that a phrase can reach, not with its whole transcript; a match has the term's first letter.
    words = transcripts.select("call_id", tokens(F.col("transcript")).alias("t"))
    ahead = words.select("call_id", F.posexplode(F.transform("t", lambda _, i: F.slice("t", i + 1, size.longest + 1))).alias("at", "t"))
    each = ahead.withColumn("token", F.get("t", F.lit(0)))
    term = F.get("terms", F.lit(0))
    first = each.join(listed, (F.left("token", F.lit(1)) == F.left(term, F.lit(1))) & term_matches(F.col("token"), term, F.get("t", F.lit(1))))
    rest = F.forall(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.coalesce(term_matches(F.get("t", i), F.get("terms", i), F.get("t", i + 1)), F.lit(False)))
    hits = first.where(rest).select("call_id", "label", F.explode(F.sequence(F.col("at"), F.col("at") + F.size("terms") - 1)).alias("covered"), (F.size("terms") > 1).alias("many"), "at")
    return hits.groupBy("call_id", "label").agg((F.count_distinct("covered") + F.max(F.col("many").cast("int"))).cast("bigint").alias("score"), F.min("at").cast("bigint").alias("position"))


def best_label(scores: DataFrame) -> DataFrame:
    """The label of the greatest score, then of the earliest hit, then by name."""
    order = F.struct(-F.col("score"), "position", "label")
    return scores.groupBy("call_id").agg(F.min(order)["label"].alias("label"), F.max("score").alias("score"))


def sanitise(transcript: Column, nature: Column) -> Column:
    """Blank for plate read-outs and bare unit status; an unsupported medical alarm follows what was said."""
    up = F.upper(transcript)
    burglar = up.rlike(r"\b(BURGLAR|BURGLARY|INTRUSION|MOTION)\b") & F.contains(nature, F.lit("ALARM DROP"))
    medical = F.contains(nature, F.lit("BURGLARY")) & up.rlike(r"\bMEDICAL (ALARM|ALERT)\b")
    plate = up.rlike(r"\b(REGISTERED TO|COMES BACK TO|LICENSE PLATE|PLATE OF)\b") & ~up.rlike(r"\b(CRASH|ACCIDENT|FIRE|INJUR)")
    status = up.rlike(r"^\W*(?:[A-Z]+ )?\d{1,4}[, ]+(?:IS )?(?:ON SCENE|EN ?ROUTE|CLEAR|AVAILABLE|BACK IN SERVICE)\W*$")
    return F.when(plate | status, "").when(burglar, "BURGLARY").when(medical, "ALARM DROP MEDICAL").otherwise(nature)


def with_fallback(nature: Column) -> Column:
    return F.coalesce(F.nullif(nature, F.lit("")), F.lit(UNKNOWN))
