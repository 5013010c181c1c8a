"""Redirects followed to their end over a table of responses, and what they say of canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.operators.joins import lookup

#: Statuses that send a client on.
REDIRECTS = [301, 302, 303, 307, 308]


def next_url(url: Column, status: Column, location: Column) -> Column:
    """Where a response sends its client, without the fragment; null if nowhere."""
    target = F.trim(F.coalesce(location, F.lit("")))
    return F.when(status.isin(REDIRECTS) & (target != ""), H.same_page_key(H.join_url(url, target)))


def redirect_ends(responses: DataFrame) -> DataFrame:
    """``url, status, hops, final_url, final_status, loop`` for every URL of ``responses`` (url, status, location).

    URLs are compared without fragment, scheme and host in lower case.  A chain ends at a URL that doesn't redirect or
    has no response (its status is null then).  One that never ends is a loop: its hops, final URL and status are null.
    Of several responses of a URL the smallest by status and location counts; null URLs are left out.

    Each round doubles how far every open chain is followed.  Chains that are still open once that is as far as there
    are open chains can have no end, as they would have to pass more URLs than there are.
    """
    rows = responses.filter("url IS NOT NULL").select(H.same_page_key(F.col("url")).alias("url"), "status", F.coalesce("location", F.lit("")).alias("location"))
    rows = rows.groupBy("url").agg(F.min(F.struct("status", "location")).alias("r"))
    rows = rows.select("url", "r.status", next_url(F.col("url"), F.col("r.status"), F.col("r.location")).alias("to"))
    nodes = rows.checkpoint()
    state = nodes.filter("to IS NOT NULL").select("url", "to", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done")).checkpoint()
    reach = 1
    while (n_open := state.filter("NOT done").count()) and reach <= 2 * n_open:
        further = state.select(F.col("url").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("done").alias("ended"))
        went = lookup(state.filter("NOT done"), further, "to")
        went = went.select(
            "url", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), (F.col("next").isNull() | F.col("ended")).alias("done")
        )
        state = went.unionByName(state.filter("done")).checkpoint()
        reach *= 2
    ended = lookup(state.filter("done"), nodes.select(F.col("url").alias("to"), F.col("status").alias("final_status")), "to")
    followed = ended.select("url", "hops", F.col("to").alias("final_url"), "final_status", F.lit(False).alias("loop"))
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("hops", "long"), ("final_url", "string"), ("final_status", nodes.schema["status"].dataType))]
    followed = followed.unionByName(state.filter("NOT done").select("url", *nothing, F.lit(True).alias("loop")))
    still = nodes.filter("to IS NULL").select("url", "status", F.lit(0).cast("long").alias("hops"), F.col("url").alias("final_url"), F.col("status").alias("final_status"), F.lit(False).alias("loop"))
    return nodes.select("url", "status").join(followed, "url").unionByName(still)


def canonical_chains(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """``page_id, status, canonical_status, hops, final_url, final_status, back, loop`` of each page (page_id, served, canonical).

    Without a canonical link, or with an empty one: warn.  One that names the page itself: pass.  One that answers with a
    redirect: fail, ``back`` if the chain comes back to the page, ``loop`` if it never ends.  Any other one: warn.  The
    link is resolved against the served URL; its fragment doesn't count, its query does.
    """
    served = H.same_page_key(F.col("served"))
    link = F.trim("canonical")
    target = F.when(link != "", H.same_page_key(H.join_url(F.col("served"), link)))
    # Written, so that the long expressions of the keys are computed once and stand alone in generated code.
    rows = pages.select("page_id", served.alias("here"), target.alias("target")).checkpoint()
    same = F.col("target") == F.col("here")
    rows = rows.select("page_id", "here", F.when(~same, F.col("target")).alias("url"), same.alias("same"))
    rows = lookup(rows, redirect_ends(responses).withColumnRenamed("status", "canonical_status"), "url")
    sent_on = F.coalesce(F.col("canonical_status").isin(REDIRECTS), F.lit(False))
    verdict = F.when(F.coalesce("same", F.lit(False)), "pass").when(sent_on, "fail").otherwise("warn")
    back = sent_on & F.coalesce(F.col("final_url") == F.col("here"), F.lit(False))
    return rows.select("page_id", verdict.alias("status"), "canonical_status", "hops", "final_url", "final_status", back.alias("back"), F.coalesce("loop", F.lit(False)).alias("loop"))
