"""Passenger registration, update and deletion batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.operators.audits import EMAIL_PATTERN
from airops.operators.commands.admission import greedy_admission, key_components
from airops.operators.commands.common import (conform, exceeds_type, new_ids, normal_email, order_key,
                                              outcomes, restrict)
from airops.operators.commands.fold import _kept, fold_in_blocks
from airops.schema import GENDERS

# --- fixed values: outcome reasons ----------------------------------------------
R_INVALID = "invalid_request"
R_PASSPORT = "passport_exists"
R_EMAIL = "email_exists"
R_GENDER = "invalid_gender"
R_404 = "passenger_not_found"
R_HAS_BOOKINGS = "passenger_has_bookings"
R_DB = "constraint_violation"
# --- end of fixed values ----------------------------------------------------------

FIELDS = ("full_name", "date_of_birth", "gender", "nationality", "passport_no", "phone", "email")


def register_passengers(t, requests: DataFrame):
    """Insert passengers. Checks in order: request shape (all fields, e-mail
    shape) 422; passport taken 409; e-mail taken 409; gender 422; a text longer than
    its column 500. E-mails are stored and compared with their domain in lower case.

    "Taken" means present in the snapshot or registered by an earlier request
    of the batch; passport and e-mail are both unique, so the admitted set is
    the two-key greedy admission (a request rejected on its passport does not
    block a later request with the same e-mail)."""
    r = (requests.select("request_id", "requested_at", *FIELDS).withColumn("email", normal_email())
         .withColumn("_ord", order_key()))
    p = t["passengers"]
    r = (r.join(restrict(p, r, "passport_no").select("passport_no", F.lit(True).alias("_pp0"))
                .distinct(), "passport_no", "left")
         .join(restrict(p, r, "email").select("email", F.lit(True).alias("_em0")).distinct(),
               "email", "left"))
    shape_ok = F.lit(True)
    for f in FIELDS:
        shape_ok = shape_ok & F.col(f).isNotNull()
    shape_ok = shape_ok & F.col("email").rlike(EMAIL_PATTERN)
    gender_ok = F.col("gender").isin(*GENDERS)
    too_long = exceeds_type("passengers", FIELDS)
    cand = shape_ok & F.col("_pp0").isNull() & F.col("_em0").isNull() & gender_ok & ~too_long
    r = r.checkpoint()
    adm = greedy_admission(r.filter(cand), ["passport_no"], ["email"])
    a = r.join(adm, "request_id", "left_semi")
    r = (r.join(a.select("passport_no", F.col("_ord").alias("_pp_at")), "passport_no", "left")
         .join(a.select("email", F.col("_ord").alias("_em_at")), "email", "left"))
    out = outcomes(r, [
        (422, R_INVALID, ~shape_ok),
        (409, R_PASSPORT, F.col("_pp0").isNotNull() | (F.col("_pp_at") < F.col("_ord"))),
        (409, R_EMAIL, F.col("_em0").isNotNull() | (F.col("_em_at") < F.col("_ord"))),
        (422, R_GENDER, ~gender_ok),
        (500, R_DB, too_long),
    ], 201)
    acc = out.filter("accepted")
    new = acc.select(new_ids(p, "passenger_id").alias("passenger_id"), *FIELDS,
                     F.col("requested_at").alias("created_at"))
    return (out.select("request_id", "accepted", "code", "reason"),
            {"passengers": p.unionByName(conform(new, p))})


def delete_passengers(t, requests: DataFrame):
    """Delete passengers without bookings: 404, then 409 if any booking
    references them. A second delete of the same passenger is a 404."""
    r = requests.select("request_id", "requested_at", "passenger_id").withColumn("_ord", order_key())
    p = restrict(t["passengers"], r, "passenger_id").select(
        "passenger_id", F.lit(True).alias("_found"))
    used = (restrict(t["bookings"], r, "passenger_id").select("passenger_id").distinct()
            .withColumn("_used", F.lit(True)))
    r = r.join(p, "passenger_id", "left").join(used, "passenger_id", "left")
    ok = F.col("_found").isNotNull() & F.col("_used").isNull()
    first = r.filter(ok).groupBy("passenger_id").agg(F.min("_ord").alias("_acc"))
    r = r.join(first, "passenger_id", "left")
    out = outcomes(r, [
        (404, R_404, F.col("_found").isNull() | (F.col("_acc") < F.col("_ord"))),
        (409, R_HAS_BOOKINGS, F.col("_used").isNotNull()),
    ], 200)
    gone = out.filter("accepted").select("passenger_id")
    return (out.select("request_id", "accepted", "code", "reason"),
            {"passengers": t["passengers"].join(gone,
                                                "passenger_id", "left_anti")})


UPDATE_FIELDS = ("full_name", "date_of_birth", "gender", "nationality", "phone", "email")


def _walk_moves(state: list | None, g: pd.DataFrame):
    """E-mail moves in order. The state holds the passengers that moved and their
    addresses; all others hold what the snapshot says, which the rows carry."""
    moved = {pid: email for pid, email in state or []}
    at: dict[str, set] = {}
    for pid, email in moved.items():
        at.setdefault(email, set()).add(pid)
    conflicts = []
    for pid, email, first, owner, mover in zip(g["passenger_id"].tolist(), g["email"].tolist(), g["_email0"].tolist(),
                                               g["_owner"].tolist(), g["_mover"].tolist()):
        now = moved.get(pid, first)
        # -1: nobody held the address before the batch
        kept = owner not in (-1, pid) and owner not in moved
        conflict = email != now and (kept or bool(at.get(email, set()) - {pid}))
        conflicts.append(conflict)
        if mover and not conflict and email != now:
            at.get(now, set()).discard(pid)
            moved[pid] = email
            at.setdefault(email, set()).add(pid)
    return pd.DataFrame({"request_id": g["request_id"], "_conflict": conflicts}), sorted(moved.items())


def _email_conflicts(setters: DataFrame) -> DataFrame:
    """(request_id, _conflict): the address is held by another passenger then.

    Requests that share a passenger or an address (the target or the address that
    the passenger had before the batch), directly or through others, form a
    component, which is walked in order by a fold in blocks. A request that shares
    nothing is decided by the snapshot alone."""
    rows = _kept(setters.withColumn("_ts", F.col("_ord.ts")).drop("_ord").withColumns({
        "_p": F.xxhash64(F.lit("passenger"), "passenger_id"), "_to": F.xxhash64(F.lit("address"), "email"),
        "_from": F.xxhash64(F.lit("address"), "_email0")}), "setters")
    keys = rows.select("request_id", F.explode(F.array_distinct(F.array("_p", "_to", "_from"))).alias("k"))
    shared = _kept(keys.groupBy("k").count().where("count > 1").select("k"), "shared-keys")
    tied = _kept(keys.join(shared, "k", "left_semi").select("request_id").distinct(), "tied")
    alone = rows.join(tied, "request_id", "left_anti").select("request_id", (
        ~F.col("email").eqNullSafe(F.col("_email0")) & (F.col("_owner") != -1) & (F.col("_owner") != F.col("passenger_id"))
    ).alias("_conflict"))
    open_ = rows.join(tied, "request_id", "left_semi")
    edges = open_.select(F.col("_p").alias("a"), F.explode(F.array("_to", "_from")).alias("b"))
    root = key_components(edges)
    placed = open_.join(root.withColumnRenamed("node", "_p"), "_p", "left").select(
        "request_id", "_ts", "passenger_id", "email", "_email0", "_owner", "_mover",
        F.coalesce("root", "_p").alias("_component"))
    out = T.StructType([rows.schema["request_id"], T.StructField("_conflict", T.BooleanType())])
    return alone.union(fold_in_blocks(placed, "_component", ["_ts", "request_id"], _walk_moves, out))


def update_passengers(t, requests: DataFrame):
    """Update passengers; only fields in ``set_fields`` change. Checks in order:
    request shape (e-mail) 422; 404; a new e-mail held by another passenger
    at that moment 409; gender 422; explicit NULL for a NOT NULL column, or a text
    longer than its column, 500. E-mails as in ``register_passengers``.

    E-mail ownership moves inside a batch (A leaves e1, then B takes e1): the
    requests that set an address are walked in order, each component of
    requests that touch the same passengers or addresses by itself, so that a
    chain of moves of any length takes the rounds of its blocks and not of its
    links. Addresses are taken to be unique in the snapshot (``audit_unique``)."""
    from airops.operators.commands.reference_data import _apply_updates, _given, _not_null_violation

    p = t["passengers"]
    r = (requests.withColumn("email", normal_email()).withColumn("_ord", order_key())
         .join(restrict(p, requests, "passenger_id")
               .select("passenger_id", F.col("email").alias("_email0"), F.lit(True).alias("_found")),
               "passenger_id", "left"))
    sets_email = _given("email") & F.col("email").isNotNull()
    shape_bad = sets_email & ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))
    gender_bad = (_given("gender") & F.col("gender").isNotNull() & (F.col("gender") != "")
                  & ~F.col("gender").isin(*GENDERS))
    db_bad = (_not_null_violation("passengers", UPDATE_FIELDS)
              | (_given("gender") & (F.col("gender") == ""))
              | exceeds_type("passengers", UPDATE_FIELDS, updates=True))
    r = r.withColumn("_mover", sets_email & ~shape_bad & F.col("_found").isNotNull()
                     & ~gender_bad & ~db_bad).checkpoint()
    setters = r.filter(sets_email & ~shape_bad & F.col("_found").isNotNull()).select(
        "request_id", "passenger_id", "email", "_email0", "_mover", "_ord")
    owners = restrict(p, setters, "email").groupBy("email").agg(F.min("passenger_id").alias("_owner"))
    setters = _email_conflicts(setters.join(owners, "email", "left").fillna(-1, ["_owner"]))
    r = r.join(setters, "request_id", "left")
    out = outcomes(r, [
        (422, R_INVALID, shape_bad),
        (404, R_404, F.col("_found").isNull()),
        (409, R_EMAIL, F.col("_conflict")),
        (422, R_GENDER, gender_bad),
        (500, R_DB, db_bad),
    ], 200)
    new = _apply_updates(p, "passenger_id", out.filter("accepted"), UPDATE_FIELDS)
    return out.select("request_id", "accepted", "code", "reason"), {"passengers": new}
