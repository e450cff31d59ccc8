"""Accounts in bulk: who a login is, who may register, and what new users are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.functions import text as T
from noteframe.operators.ordered import numbered, running
from noteframe.sources.storage import kept


def resolve_identity(logins: DataFrame, users: DataFrame) -> DataFrame:
    """login_id, user_id and action: matched by google_id, else linked by email, else created (without a user yet)."""
    by_id = users.where("google_id is not null").select("google_id", F.col("id").alias("_by_id"))
    by_mail = users.select("email", F.col("id").alias("_by_mail"))
    rows = logins.join(by_id, "google_id", "left").join(by_mail, "email", "left")
    action = F.when(F.col("_by_id").isNotNull(), "matched").when(F.col("_by_mail").isNotNull(), "linked").otherwise("created")
    return rows.select("login_id", F.coalesce("_by_id", "_by_mail").alias("user_id"), action.alias("action"))


def linked_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users with the google_id of the first login that was linked to them; one that they have stays."""
    links = resolve_identity(logins, users).where("action = 'linked'").join(logins.select("login_id", F.col("google_id").alias("_new")), "login_id")
    first = links.groupBy(F.col("user_id").alias("id")).agg(F.min_by("_new", "login_id").alias("_new"))
    return users.join(first, "id", "left").withColumn("google_id", F.coalesce("google_id", "_new")).drop("_new")


def check_registration(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """candidate_id and outcome: email_taken, username_taken or ok, as if candidates came one after the other by candidate_id.

    Only who is accepted takes an email and a name, so an outcome can hang on earlier ones. In each round those who are the
    first of all that wait, both for their email and for their name, are accepted, and all who want what these took are
    refused; the others wait. It ends when nobody waits, after as many rounds as outcomes hang on each other. Null emails and names are
    never taken.
    """
    keys = ("email", "username")
    plain = lambda c: F.concat(F.lit("="), F.col(c))
    waiting = candidates.select("candidate_id", *(F.coalesce(plain(c), F.concat(F.lit("#"), F.col("candidate_id").cast("string"))).alias(c) for c in keys))
    for c in keys:
        waiting = waiting.join(users.where(F.col(c).isNotNull()).select(plain(c).alias(c)).distinct(), c, "left_anti")
    waiting, accepted = kept(waiting.select("candidate_id", *keys), "waiting"), None
    while not waiting.isEmpty():
        by_mail = waiting.groupBy("email").agg(F.min(F.struct("candidate_id", "username")).alias("first")).select("first.candidate_id", "email", "first.username")
        by_name = waiting.groupBy("username").agg(F.min("candidate_id").alias("candidate_id"))
        won = kept(by_mail.join(by_name.select("candidate_id"), "candidate_id", "left_semi"), "accepted")
        accepted = won if accepted is None else accepted.union(won)
        for c in keys:
            waiting = waiting.join(won.select(c), c, "left_anti")
        waiting = kept(waiting.select("candidate_id", *keys), "waiting")
    rows = candidates.select("candidate_id", *keys)
    for c in keys:
        owned = users.where(F.col(c).isNotNull()).select(c, F.lit(True).alias("_user")).distinct()
        taken = owned.withColumn("_by", F.lit(None).cast(dict(rows.dtypes)["candidate_id"]))
        if accepted is not None:
            taken = taken.union(accepted.where(F.startswith(F.col(c), F.lit("="))).select(F.substring(c, F.lit(2), F.length(c)), F.lit(False), "candidate_id"))
        rows = rows.join(taken, c, "left").withColumn(f"_{c}", F.coalesce(F.col("_user") | (F.col("_by") < F.col("candidate_id")), F.lit(False))).drop("_user", "_by")
    return rows.select("candidate_id", F.when(F.col("_email"), "email_taken").when(F.col("_username"), "username_taken").otherwise("ok").alias("outcome"))


def _numbers(waiting: DataFrame, taken: DataFrame) -> DataFrame:
    """login_id, slug, username: each newcomer of a slug gets the slug's next free number, given the taken names.

    The n-th newcomer gets n and one more for each taken number that has at most n free ones below it. Newcomers and taken
    numbers are placed in one sort; in another both meet by how many free numbers lie below them.
    """
    suffix = F.regexp_extract("username", r"_([1-9][0-9]{0,17})$", 1)
    stems = taken.select(F.explode(F.array(F.struct(F.col("username").alias("slug"), F.lit(0).cast("long").alias("v")), F.struct(F.regexp_replace("username", r"_[1-9][0-9]{0,17}$", "").alias("slug"), F.try_to_number(suffix, F.lit("9" * 18)).cast("long").alias("v")))).alias("s"))
    stems = stems.select("s.slug", "s.v").where("v is not null").join(waiting.select("slug").distinct(), "slug", "left_semi")
    both = waiting.select("slug", F.lit(0).cast("long").alias("used"), F.col("login_id").alias("v")).unionByName(stems.withColumn("used", F.lit(1).cast("long")))
    placed = numbered(both, ["slug", "used"], [F.col("v")])
    below = F.when(F.col("used") == 1, F.col("v") - F.col("turn") + 1).otherwise(F.col("turn") - 1)
    met = running(placed.withColumn("below", below), ["slug"], [F.col("below"), F.col("used").desc(), F.col("v")], skipped="used")
    k = F.col("below") + F.col("skipped")
    name = F.when(k == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), k.cast("string")))
    return met.where("used = 0").select(F.col("v").alias("login_id"), "slug", name.alias("username"))


def assign_usernames(new: DataFrame, users: DataFrame) -> DataFrame:
    """login_id and username: the slug, or the first free of slug_1, slug_2, ..., as if logins came one after the other by login_id.

    A slug can look like another's candidate (a_1). Where two slugs' newcomers claim one name, the later one has lost it:
    the claims of its slug before that are settled, the others are numbered again, until no name is claimed twice.
    """
    waiting, taken, done = new.select("login_id", T.username_slug("name", "email").alias("slug")), users.select("username").distinct(), None
    while True:
        claims = kept(_numbers(waiting, taken), "claims")
        twice = claims.groupBy("username").agg(F.count(F.lit(1)).alias("_n"), F.min("login_id").alias("_first")).where("_n > 1")
        lost = claims.join(twice, "username").where("login_id > _first").groupBy("slug").agg(F.min("login_id").alias("_lost"))
        lost = kept(lost, "lost")
        if lost.isEmpty():
            last = claims.select("login_id", "username")
            return last if done is None else done.union(last)
        judged = kept(claims.join(lost, "slug", "left").withColumn("_settled", F.coalesce(F.col("login_id") < F.col("_lost"), F.lit(True))), "judged")
        settled = judged.where("_settled").select("login_id", "username")
        done = settled if done is None else done.union(settled)
        taken, waiting = taken.union(settled.select("username")), judged.where("not _settled").select("login_id", "slug")
