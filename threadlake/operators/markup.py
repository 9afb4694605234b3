"""Facts stated in messages: orders, parcels, bills, flights, stays and bookings, from JSON-LD and microdata first and patterns where there is none.

But for the tags of microdata everything is built from SQL functions: blocks by pattern, items as JSON strings, fields by path. A fact has kind, name,
ref, number, amount, currency, starts, ends and status; what a message does not say is null. Null and empty texts give no
facts, broken JSON gives none for its block, and unknown types are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import microdata

FIELDS = ("kind", "name", "ref", "number", "amount", "currency", "starts", "ends", "status")
BLOCK = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
#: Item types of schema.org and the kind of fact that each is.
TYPES = {
    "FlightReservation": "flight",
    "LodgingReservation": "lodging",
    "FoodEstablishmentReservation": "restaurant",
    "EventReservation": "event",
    "RentalCarReservation": "rentalCar",
    "TrainReservation": "train",
    "BusReservation": "bus",
    "ParcelDelivery": "shipment",
    "Order": "order",
    "Invoice": "bill",
}
#: States of schema.org whose name here is another.
STATES = {"complete": "paid", "automaticallyApplied": "paid", "pastDue": "overdue", "paymentDue": "due", "problem": "exception", "pickupAvailable": "delivered"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used; Spark repeats an expression inside a lambda at each place where it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(html: Column) -> Column:
    """Bodies of JSON-LD script elements; a body that some mailer escaped is unescaped. The page is cut at its script tags once."""
    return bound(F.split(F.coalesce(html, F.lit("")), r"(?i)<script(?![A-Za-z0-9-])"), bodies)


def bodies(parts: Column) -> Column:
    # behind each opening: attributes up to >, then the body up to the first end tag
    opened = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.contains(F.lower(F.substring_index(p, ">", 1)), F.lit("application/ld+json")))
    closed = F.transform(F.filter(opened, lambda p: F.lower(p).contains("</script")), lambda p: F.get(F.split(F.substr(p, F.instr(p, ">") + 1), r"(?i)</script", 2), F.lit(0)))
    return F.transform(closed, lambda b: F.trim(F.when(F.try_parse_json(b).isNull(), X.entities(b)).otherwise(b)))


def listed(json: Column) -> Column:
    """A JSON array's elements, or the one value, as JSON strings."""
    return bound(json, lambda j: F.from_json(F.when(j.startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]"))), "array<string>"))


def items(html: Column) -> Column:
    """Items of all blocks: of arrays and graphs each member."""
    roots = F.flatten(F.transform(blocks(html), lambda b: F.coalesce(listed(b), F.array().cast("array<string>"))))
    members = F.flatten(F.transform(roots, lambda r: F.coalesce(listed(F.get_json_object(r, "$.@graph")), F.array(r))))
    return F.filter(members, lambda m: m.isNotNull())


def said(item: Column, *paths: str) -> Column:
    """The first path with a text, of a parsed item: of a list its first member, of an object its name; blank is null."""
    def plain(x: Column) -> Column:
        return bound(x, lambda v: F.when(~v.startswith("{") & ~v.startswith("[") & (F.trim(v) != ""), F.trim(v)))

    def text(value: Column) -> Column:
        at = lambda rest: plain(F.try_variant_get(value, f"${rest}", "string"))
        return F.when(value.isNotNull(), F.coalesce(at("[0].name"), at(".name"), at("[0]"), at("")))

    def one(path: str) -> Column:
        return bound(F.try_variant_get(item, f"$.{path}", "variant"), text)

    return F.coalesce(*[one(p) for p in paths])


def number(text: Column) -> Column:
    """A written number: the last separator is decimal if one or two digits follow."""
    def read(digits: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(digits, r"[.,][0-9]{1,2}$", ""), r"[.,]", "")
        return F.concat(whole, F.when(digits.rlike(r"[.,][0-9]{1,2}$"), F.concat(F.lit("."), F.regexp_extract(digits, r"[.,]([0-9]{1,2})$", 1))).otherwise(F.lit(""))).try_cast("double")

    return bound(F.regexp_extract(text, r"[0-9][0-9.,]*", 0), read)


def state(text: Column) -> Column:
    """The last part of a state's address without what it is a state of, from a small letter on."""
    last = F.regexp_replace(F.regexp_extract(text, r"([A-Za-z]+)$", 1), r"^(Order|Reservation|Payment)(?=[A-Z])", "")
    mapped = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    low = bound(last, lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return bound(low, lambda x: F.when(x != "", F.coalesce(F.try_element_at(mapped, x), x)))


def kind_of(item: Column) -> Column:
    """The kind of the first of an item's types that is known; case and what stands before the type's name do not count."""
    kinds = F.create_map(*[F.lit(x) for t, k in TYPES.items() for x in (t.lower(), k)])
    path = "$['@type']"
    types = F.coalesce(F.try_variant_get(item, path, "array<string>"), F.array(F.try_variant_get(item, path, "string")))
    known = F.transform(types, lambda t: F.try_element_at(kinds, F.lower(F.regexp_extract(F.trim(t), r"([A-Za-z]+)$", 1))))
    return F.get(F.filter(known, lambda k: k.isNotNull()), F.lit(0))


def fact_of(text: Column) -> Column:
    """The fact that an item, a JSON string, states, or null; it is parsed once, and each of its fields looked up once."""
    return bound(F.try_parse_json(text), lambda item: bound(F.struct(kind_of(item).alias("kind"), money_of(item).alias("money")), lambda known: stated(item, known["kind"], known["money"])))


def money_of(item: Column) -> Column:
    return number(said(item, "totalPaymentDue.price", "totalPaymentDue", "totalPrice", "price", "minimumPaymentDue.price", "partOfOrder.price"))


def stated(item: Column, kind: Column, money: Column) -> Column:
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("kind"),
            said(item, "merchant", "seller", "partOfOrder.merchant", "partOfOrder.seller", "reservationFor.airline", "reservationFor", "provider", "broker").alias("name"),
            said(item, "orderNumber", "partOfOrder.orderNumber", "reservationNumber", "reservationId", "confirmationNumber", "identifier", "accountId").alias("ref"),
            F.replace(said(item, "trackingNumber", "reservationFor.flightNumber"), F.lit(" "), F.lit("")).alias("number"),
            money.alias("amount"),
            F.when(money.isNotNull(), said(item, "priceCurrency", "totalPaymentDue.priceCurrency", "partOfOrder.priceCurrency")).alias("currency"),
            said(item, "checkinTime", "checkinDate", "startTime", "reservationFor.departureTime", "reservationFor.startDate", "orderDate", "paymentDueDate", "paymentDue", "expectedArrivalUntil", "expectedArrivalFrom").alias("starts"),
            said(item, "checkoutTime", "checkoutDate", "endTime", "reservationFor.arrivalTime", "reservationFor.endDate").alias("ends"),
            state(said(item, "orderStatus", "reservationStatus", "paymentStatus", "deliveryStatus.hasDeliveryMethod", "deliveryStatus", "partOfOrder.orderStatus")).alias("status"),
        ),
    )


def carrier(candidate: Column) -> Column:
    """Whose tracking number it is, by form and check digit; null if nobody's."""
    usps = candidate.rlike(r"^9[1-5][0-9]{20}$") & X.mod10_ok(candidate)
    return F.when(X.ups_ok(candidate), "UPS").when(F.coalesce(usps, F.lit(False)), "USPS").when(X.s10_ok(candidate), "Post").when(X.fedex12_ok(candidate), "FedEx")


def patterned(text: Column) -> Column:
    """Facts by patterns: a bill has an invoice number and a sum that is due, an order an order number, a parcel a tracking number whose check digit
    holds. Twelve digits are too common for the check alone: they count where the text names the carrier."""
    x = F.coalesce(text, F.lit(""))
    got = lambda pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    invoice = got(r"(?i)\binvoice\s*(?:number|no\.?|#)?\s*[:#]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]*)")
    order = got(r"(?i)\border\s*(?:number|no\.?|#)?\s*[:#]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]{2,})")
    due = got(r"(?i)\b(?:amount|balance|total)\s+due\s*:?\s*([$€£]\s?[0-9][0-9.,]*)")
    day = got(r"(?i)\bdue\s+(?:date|on|by)\s*:?\s*([0-9]{4}-[0-9]{2}-[0-9]{2})")
    marks = F.create_map(F.lit("$"), F.lit("USD"), F.lit("€"), F.lit("EUR"), F.lit("£"), F.lit("GBP"))
    total = X.receipt_total(x)
    mark = F.regexp_extract(x, r"([$€£])\s?[0-9]", 1)
    codes = F.filter(F.regexp_extract_all(x, F.lit(r"\b(1Z[0-9A-Z]{16}|[A-Z]{2}[0-9]{9}[A-Z]{2}|[0-9]{22}|[0-9]{12})\b"), F.lit(1)), lambda c: carrier(c).isNotNull() & ((carrier(c) != "FedEx") | x.rlike("(?i)fedex")))

    def fact(**known: Column) -> Column:
        kinds = {"amount": "double"}
        return F.struct(*[known.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS])

    bill = F.when(invoice.isNotNull() & due.isNotNull(), F.array(fact(kind=F.lit("bill"), ref=invoice, amount=number(due), currency=F.try_element_at(marks, F.substring(due, 1, 1)), starts=day)))
    bought = F.when(order.isNotNull(), F.array(fact(kind=F.lit("order"), ref=order, amount=total.try_cast("double"), currency=F.when(total.isNotNull(), F.try_element_at(marks, mark)))))
    none = F.slice(F.array(fact(kind=F.lit("none"))), 1, 0)
    parcels = F.transform(F.array_distinct(codes), lambda c: fact(kind=F.lit("shipment"), name=carrier(c), ref=order, number=c))
    return F.concat(F.coalesce(bill, none), F.coalesce(bought, none), parcels)


def facts(messages: DataFrame, ident: str, html: str, text: str) -> DataFrame:
    """(ident, fact's fields): what the markup says; kinds that it does not mention are taken from the text."""
    rows = messages.select(F.col(ident), F.filter(F.transform(F.concat(items(F.col(html)), microdata.items(F.col(html))), fact_of), lambda f: f.isNotNull()).alias("stated"), F.col(text).alias("__text"))
    known = F.transform("stated", lambda f: f["kind"])
    rest = F.filter(patterned(F.col("__text")), lambda f: ~F.array_contains(known, f["kind"]))
    # the generator's input is no column by itself: of a column Spark would infer a condition that works everything out a second time
    return rows.select(ident, F.inline(F.concat(F.col("stated"), rest)))
