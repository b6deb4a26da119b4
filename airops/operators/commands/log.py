"""``apply_commands``: a day's log of mixed commands in one time order.

The log holds bookings, payments, cancellations and boarding events, tagged by
``command``; each is answered as if they were applied one at a time in
(requested_at, request_id) order. A command names an existing ``booking_id``, or
by ``booking_request_id`` the booking that a ``book`` of the same log makes.

1. Payments, cancellations and boardings of one booking depend on one another
   only through three moments, which are minima over the booking's commands (no
   walk, so a hot booking costs one partial row a task): the first cancellation,
   the first payment that the database takes if it comes before that, and the first
   boarding event while the booking is Confirmed. For a booking that the log
   itself makes they hold if it is made.
2. Whether it is made depends on the seat, on the passenger's other bookings of
   the flight and on the seats taken of the flight, which cancellations free and
   boardings occupy: ``seating.py``.
3. Codes and tables follow from the moments and the bookings that were made.

What is read again (the bookings named, their moments) is written once as tables to
the scratch folder: a reader takes only its columns from there. The commands that
moments come from are written with the columns that these need, and dropped
then. Codes and tables are plans over the log and those tables, so that a caller
pays for those that it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.operators.commands import booking_flow as flow
from airops.operators.commands import bookings_admit as admit
from airops.operators.commands.common import conform, new_ids, order_key, outcomes, restrict, upsert
from airops.operators.commands.fold import _kept
from airops.operators.commands.seating import decide_bookings
from airops.schema import BOARDING_STATUS, PAYMENT_METHOD
from airops.session import temporary

COMMANDS = ("book", "pay", "cancel", "board")
_MONEY = T.DecimalType(12, 2)


# --- 1: the moments of a booking ---------------------------------------------------

def _between(order: Column, after: Column, before: Column) -> Column:
    """``order`` lies after one moment (null: always) and before another (null: always)."""
    return (after.isNull() | (order > after)) & (before.isNull() | (order < before))


_MARKS = {"paid": "payments", "ticketed": "tickets", "record": "boarding_records"}


def _targets(t, log: DataFrame, books: DataFrame) -> DataFrame:
    """The bookings that the log's commands name: those of the snapshot (``target``
    is the id) and those that its requests may make (minus the request's id, less one)."""
    named = log.where("command <> 'book'").select("booking_id")
    old = restrict(t["bookings"], named, "booking_id")
    # payments, tickets and boarding records of the named bookings, found in one pass
    marks = None
    for mark, table in _MARKS.items():
        part = t[table].select("booking_id", *[(F.lit(True) if c == mark else F.lit(None).cast("boolean")).alias(c)
                                               for c in _MARKS])
        marks = part if marks is None else marks.unionByName(part)
    marks = restrict(marks, named, "booking_id").groupBy("booking_id").agg(*[F.max(c).alias(c) for c in _MARKS])
    # each way through the shuffles is written before the next: only its own files are there at a time
    old = _kept(old.join(marks, "booking_id", "left").select(
        F.col("booking_id").alias("target"), "flight_id", "seat_id", "passenger_id", F.col("status").alias("was"), "paid",
        "ticketed", "record", F.lit(None).cast(books.schema["_ord"].dataType).alias("start")), "named")
    new = books.select((-F.col("request_id") - 1).alias("target"), "flight_id", "seat_id", "passenger_id",
                       F.lit("Pending").alias("was"), *[F.lit(None).cast("boolean").alias(c) for c in (
                           "paid", "ticketed", "record")], F.col("_ord").alias("start"))
    both = old.unionByName(new)
    fare = (restrict(t["seats"], both, "seat_id").select("seat_id", "fare_class_id")
            .join(t.dim("fare_classes").select("fare_class_id", "multiplier"), "fare_class_id"))
    price = restrict(t["flights"], both, "flight_id").select("flight_id", "base_fare")
    return both.join(fare, "seat_id", "left").join(price, "flight_id", "left").withColumn(
        "fare", (F.col("base_fare") * F.col("multiplier")).try_cast(_MONEY))


def _moments(cmds: DataFrame) -> DataFrame:
    """Per target that has one: its first cancellation ``c``, the payment ``p`` taken
    before it, the first boarding ``b`` while Confirmed, and the last status that
    boarding sets."""
    kind = F.col("command")
    pays = (kind == "pay") & F.col("paid").isNull() & ~F.col("db_fail")
    valid = _kept(cmds.where(F.col("shape_ok") & F.col("target").isNotNull() & F.col("was").isNotNull() & (
        F.col("after").isNull() | F.col("after")) & (F.col("was") != "Cancelled") & (
            kind.isin("cancel", "board") | pays)).select(
                "target", "was", "command", "boarding_status", "requested_at", "request_id"), "commands").withColumn(
                    "_ord", order_key())
    pays = kind == "pay"
    first = valid.where((kind == "cancel") | pays).groupBy("target").agg(
        F.min(F.when(kind == "cancel", F.col("_ord"))).alias("c"), F.min(F.when(pays, F.col("_ord"))).alias("p"))
    first = _kept(first.withColumn("p", F.when(F.col("c").isNull() | (F.col("p") < F.col("c")), F.col("p"))), "first")
    boards = valid.where(kind == "board").select("target", "was", "_ord", "boarding_status").join(
        first, "target", "left").where(((F.col("was") == "Confirmed") | (F.col("_ord") > F.col("p"))) & (
            F.col("c").isNull() | (F.col("_ord") < F.col("c"))))
    board = boards.groupBy("target").agg(F.min("_ord").alias("b"), F.min_by("boarding_status", "_ord").alias("b_first"),
                                         F.max_by("boarding_status", "_ord").alias("b_last"))
    return _kept(first.join(board, "target", "full"), "moments")


def apply_commands(t, log: DataFrame):
    """Outcomes and changed tables of a mixed log.

    ``log``: request_id, requested_at, command; booking_id or booking_request_id;
    passenger_id, flight_id, seat_id, staff_id (book); method, amount (pay);
    cancel_reason (cancel); boarding_status (board). An unknown command is a 422."""
    log = log.withColumn("_ord", order_key())
    books = log.where("command = 'book'").select("request_id", "requested_at", "passenger_id", "flight_id", "seat_id",
                                                 "staff_id", "_ord")
    target = F.coalesce(F.col("booking_id"), -F.col("booking_request_id") - 1)
    amount = F.col("amount").try_cast(_MONEY)
    shape = (F.when(F.col("command") == "pay", F.col("method").isin(*PAYMENT_METHOD) & F.col("amount").isNotNull())
             .when(F.col("command") == "cancel", F.col("cancel_reason").isNotNull())
             .when(F.col("command") == "board", F.col("boarding_status").isin(*BOARDING_STATUS)))
    cmds = log.where("command is null or command <> 'book'").select(
        "request_id", "requested_at", "command", "method", "cancel_reason", "boarding_status", target.alias("target"),
        amount.alias("amount"), (F.coalesce(shape, F.lit(False)) & target.isNotNull()).alias("shape_ok"))
    with temporary() as keep:
        targets = keep(_kept(_targets(t, log, books), "targets"))
    facts = targets.drop("flight_id", "seat_id", "passenger_id")
    # ``after``: it follows the request of a booking that the log may make (null: a booking of the snapshot)
    cmds = cmds.join(facts, "target", "left").withColumn(
        "db_fail", F.col("amount").isNull() | (F.col("amount") <= 0) | F.col("ticketed").isNotNull() | F.col("fare").isNull()
        | (F.col("fare") <= 0)).withColumn("after", order_key() > F.col("start")).drop("ticketed", "start").withColumn("_ord", order_key())
    # only the bookings that something happens to
    with temporary() as keep:
        known = keep(_kept(targets.where("was is not null").select(
            "target", "flight_id", "seat_id", "passenger_id", "was", "record").join(_moments(cmds), "target").where(
                "c is not null or p is not null or b is not null").distinct(), "known"))

    made = decide_bookings(t, books, known)
    # a booking that the snapshot holds twice has the same moments in each of its rows
    moments = known.groupBy("target").agg(*[F.first(m).alias(m) for m in "cpb"])
    out = _codes(cmds, moments, made)
    return out.select("request_id", "accepted", "code", "reason").unionByName(
        made.select("request_id", (F.col("code") < 300).alias("accepted"), "code", "reason")), _tables(t, books, known, made, out)


# --- 3: codes and tables -----------------------------------------------------------------

def _codes(cmds: DataFrame, moments: DataFrame, made: DataFrame) -> DataFrame:
    done = made.where("code = 201").select((-F.col("request_id") - 1).alias("target"), F.lit(True).alias("made"))
    j = cmds.join(moments, "target", "left").join(done, "target", "left")
    at, kind = F.col("_ord"), F.col("command")
    exists = F.col("was").isNotNull() & (F.col("after").isNull() | (F.col("made").isNotNull() & F.col("after")))
    gone = (F.col("was") == "Cancelled") | (F.col("c") < at)
    confirmed = ((F.col("was") == "Confirmed") | (F.col("p") < at)) & ~F.coalesce(gone, F.lit(False))
    pay, cancel, board = kind == "pay", kind == "cancel", kind == "board"
    return outcomes(j, [
        (422, flow.R_INVALID, ~F.col("shape_ok")),
        (404, flow.R_BOOKING_404, ~exists),
        (409, flow.R_ALREADY_CANCELLED, cancel & gone),
        (200, "ok", cancel),
        (409, flow.R_CANCELLED, pay & gone),
        (409, flow.R_PAYMENT_EXISTS, pay & (F.col("paid").isNotNull() | (F.col("p") < at))),
        (500, flow.R_DB, pay & F.col("db_fail")),
        (422, flow.R_NOT_CONFIRMED, board & ~F.coalesce(confirmed, F.lit(False))),
        (201, "status_updated", board & (F.col("record").isNotNull() | (F.col("b") < at))),
        (201, "boarding_recorded", board),
    ], 201)


def _tables(t, books: DataFrame, known: DataFrame, made: DataFrame, out: DataFrame) -> dict[str, DataFrame]:
    new_book = books.join(made.where("code = 201"), "request_id", "left_semi")
    booked_id = new_ids(t["bookings"], "booking_id")
    held = known.join(new_book.select((-F.col("request_id") - 1).alias("target"), F.lit(True).alias("_made")), "target", "left"
                      ).where("target >= 0 or _made")
    acc = out.where("accepted")
    cancels = acc.where("command = 'cancel'").select("target", "cancel_reason", F.col("requested_at").alias("cancelled_at"))
    pays = acc.where("command = 'pay'")
    # bookings
    status = held.where("c is not null or p is not null").join(cancels, "target", "left").select(
        "target", F.when(F.col("c").isNotNull(), "Cancelled").otherwise("Confirmed").alias("status"), "cancel_reason",
        "cancelled_at")
    b = t["bookings"]
    old = upsert(b, status.select(F.col("target").alias("booking_id"), "status", "cancel_reason", "cancelled_at"), "booking_id",
                 ["status", "cancel_reason", "cancelled_at"])
    new = new_book.withColumn("target", -F.col("request_id") - 1).join(status, "target", "left").select(
        booked_id.alias("booking_id"), "passenger_id", "flight_id", "seat_id", "staff_id",
        admit.pnr_for(F.col("request_id")).alias("pnr"), F.coalesce("status", F.lit("Pending")).alias("status"), "cancel_reason",
        "cancelled_at", F.col("requested_at").alias("booked_at"))
    # seats: the last of what happened to each
    seen = [new_book.select("seat_id", F.col("_ord").alias("at"), F.lit("Reserved").alias("status")),
            held.where("c is not null").select("seat_id", F.col("c").alias("at"), F.lit("Available").alias("status")),
            held.where("b is not null and b_first = 'Boarded' and record is null").select(
                "seat_id", F.col("b").alias("at"), F.lit("Occupied").alias("status"))]
    last = seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("seat_id").agg(F.max_by("status", "at").alias("status"))
    # payments and tickets: made ones are born refunded or cancelled if that followed
    id_of = F.when(F.col("target") >= 0, F.col("target")).otherwise(new_ids(b, "booking_id", "_rid"))
    gone = cancels.select("target", F.col("cancelled_at").alias("_at"))
    paid = pays.withColumn("_rid", -F.col("target") - 1).join(gone, "target", "left").withColumn("_b", id_of)
    back = F.col("_at").isNotNull()
    new_pay = paid.select(
        new_ids(t["payments"], "payment_id").alias("payment_id"), F.col("_b").alias("booking_id"), "method", "amount",
        F.when(back, "Refunded").otherwise("Completed").alias("status"),
        F.when(back, F.col("amount")).otherwise(F.lit(0)).cast(_MONEY).alias("refund_amount"),
        F.col("requested_at").alias("payment_date"), F.coalesce("_at", "requested_at").alias("updated_at"))
    p = t["payments"].join(gone.withColumnRenamed("target", "booking_id"), "booking_id", "left")
    refund = back & (F.col("status") == "Completed")
    old_pay = p.withColumn("refund_amount", F.when(refund, F.col("amount")).otherwise(F.col("refund_amount"))).withColumn(
        "updated_at", F.when(refund, F.col("_at")).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(refund, "Refunded").otherwise(F.col("status")))
    new_ticket = paid.select(
        new_ids(t["tickets"], "ticket_id").alias("ticket_id"), F.col("_b").alias("booking_id"), "fare_class_id",
        F.concat(F.lit("TKT-R"), F.col("request_id").cast("string")).alias("ticket_no"), "base_fare",
        F.col("multiplier").alias("multiplier_snapshot"), F.col("fare").alias("final_fare"),
        F.col("requested_at").alias("issue_date"), back.alias("is_cancelled"))
    old_ticket = upsert(t["tickets"], gone.select(F.col("target").alias("booking_id"), F.lit(True).alias("is_cancelled")),
                        "booking_id", ["is_cancelled"])
    # boarding records
    boarded = held.where("b is not null").withColumn("_rid", -F.col("target") - 1).withColumn("_b", id_of)
    br = t["boarding_records"]
    old_record = upsert(br, boarded.select(F.col("_b").alias("booking_id"), F.col("b_last").alias("status")), "booking_id",
                        ["status"])
    new_record = boarded.where("record is null").withColumn("_eid", F.col("b.id")).select(
        new_ids(br, "boarding_id", "_eid").alias("boarding_id"), F.col("_b").alias("booking_id"), "passenger_id", "flight_id",
        F.col("b_last").alias("status"), F.col("b.ts").alias("boarded_at"))
    return {"bookings": old.unionByName(conform(new, b)), "seats": upsert(t["seats"], last, "seat_id", ["status"]),
            "payments": conform(old_pay, t["payments"]).unionByName(conform(new_pay, t["payments"])),
            "tickets": old_ticket.unionByName(conform(new_ticket, t["tickets"])),
            "boarding_records": old_record.unionByName(conform(new_record, br))}
