"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Letters that have no decomposition but fold all the same.
_PLAIN = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ŧ": "t"}


def _folds() -> tuple[str, str]:
    """Lower-case letters with marks and the letters without, by canonical decomposition."""
    made = dict(_PLAIN)
    for i in range(0xC0, 0x250):
        c = chr(i)
        base = unicodedata.normalize("NFD", c)[0]
        if c.islower() and base != c and base.isascii():
            made[c] = base
    return "".join(made), "".join(made.values())


FOLD_FROM, FOLD_TO = _folds()


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased and folded; null gives none."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def has_word(toks: Column, word: str) -> Column:
    return F.array_contains(toks, word)


def has_prefix(toks: Column, prefix: str) -> Column:
    """From three characters on; a shorter prefix must be the whole word."""
    return F.exists(toks, lambda t: t.startswith(prefix)) if len(prefix) >= 3 else has_word(toks, prefix)


def has_phrase(toks: Column, words: list[str]) -> Column:
    """The words one after another."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def positions(toks: Column, word: str) -> Column:
    return F.filter(F.transform(toks, lambda t, i: F.when(t == word, i)), lambda p: p.isNotNull())


def near(toks: Column, a: str, b: str, n: int) -> Column:
    """At most ``n`` other words between the two, in either order; the text is looked through once."""
    if a == b:
        return has_word(toks, a)
    between = r"(?: [^ ]+){0,%d} " % n
    either = "|".join(f"(?:^| ){re.escape(x)}{between}{re.escape(y)}(?: |$)" for x, y in ((a, b), (b, a)))
    return F.array_join(toks, " ").rlike(either)


def negated(predicate: Column) -> Column:
    """NOT in two-valued logic: what is unknown does not hold, so its negation does."""
    return ~F.coalesce(predicate, F.lit(False))


def entities(text: Column) -> Column:
    """The entities that mail is full of, decoded; the ampersand last, so that nothing is decoded twice."""
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def without_hidden(html: Column) -> Column:
    """A page with a space for each script, style and head.

    The page is cut behind their closing tags once; in each piece what follows its first opening tag goes. What is behind the last closing tag stays,
    as do closing tags that nothing opened, so time is linear in the page.
    """
    pieces = F.split(html, r"(?i)(?<=</(?:script|style|head)>)")
    opening = r"(?i)<(?:script|style|head)(?![A-Za-z0-9_])"
    hidden = lambda p: p.rlike(opening) & F.lower(F.right(p, F.lit(9))).rlike(r"</(?:script|style|head)>$")
    shown = lambda p: F.concat(F.get(F.split(p, opening, 2), F.lit(0)), F.lit(" "))
    return F.array_join(F.transform(pieces, lambda p: F.when(hidden(p), shown(p)).otherwise(p)), "")


def html_text(html: Column) -> Column:
    """Text of a page: script, style and head go, blocks become line breaks, tags go, entities are decoded, spaces collapse."""
    x = without_hidden(F.coalesce(html, F.lit("")))
    x = F.regexp_replace(x, r"(?i)<(/p|/div|/li|/tr|/h[1-6]|br)[^>]*>", "\n")
    x = entities(F.regexp_replace(x, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


#: Parameters by which advertisers and mailers know a reader again, as browsers strip them.
TRACKERS = (
    "__s", "_hsenc", "fbclid", "mc_eid", "mkt_tok", "oly_anon_id", "oly_enc_id", "vero_id", "__hsfp", "__hssc", "__hstc", "_openstat", "dclid", "gbraid", "gclid", "hsctatracking", "msclkid", "twclid", "wbraid", "wickedid", "yclid", "ysclid",
    "_branch_match_id", "bsft_clkid", "et_rid", "fb_action_ids", "guce_referrer", "igshid", "irclickid", "ml_subscriber", "ml_subscriber_hash", "rb_clickid", "s_cid", "sfmc_id", "sfmc_activityid", "srsltid", "ss_email_id", "ttclid", "vero_conv", "ymclid",
)
#: What a path or query has of pages on which people manage their subscription; such links need their parameters.
SUBSCRIPTION_WORDS = ("unsub", "optout", "opt-out", "opt_out", "preference", "subscription", "manage", "remove")


def without_tracking(url: Column) -> Column:
    """The url without the parameters that follow people around. Campaign tags say nothing about who reads, and stay; so does ``ref``, which ordinary links need, and everything in links that manage a subscription."""
    x = F.regexp_replace(url, rf"(?i)([?&])({'|'.join(TRACKERS)})=[^&#]*", "$1")
    x = F.regexp_replace(x, r"&&+", "&")
    x = F.regexp_replace(F.regexp_replace(x, r"\?&", "?"), r"[?&]+(#|$)", "$1")
    place = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[^/]*//[^/?#]*", ""), r"#.*$", ""))
    return F.when(place.rlike("|".join(SUBSCRIPTION_WORDS)), url).otherwise(x)


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space, and lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def chunk_words(words: Column, opening: int = 90, size: int = 120, overlap: int = 20, tail: int = 8, most: int | None = None) -> Column:
    """(start, length) of passages: an opening, then windows with overlap; a tail of few new words joins the passage before it. The whole text, unless ``most`` passages are asked for."""
    n, step, first = F.size(words), size - overlap, opening - overlap
    more = F.greatest(F.ceil((n - opening) / step), F.lit(0)).cast("int")
    last_new = n - opening - (more - 1) * step
    merged = (more > 0) & (last_new < tail)
    full = F.when(merged, more - 1).otherwise(more) + 1
    count = full if most is None else F.least(full, F.lit(most))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.lit(first) + (i - 1) * step)
    end = lambda i: F.when(i == 0, F.lit(opening)).otherwise(start(i) + size)
    whole = merged if most is None else merged & (full <= most)
    length = lambda i: F.when(whole & (i == count - 1), n).otherwise(F.least(end(i), n)) - start(i)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk"), start(i).alias("start"), length(i).alias("length"))))


def amounts(text: Column) -> Column:
    """Numbers behind a currency mark, as strings with a decimal point. The last separator is decimal if one or two digits follow, else a thousands mark."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[$€£]\s?([0-9][0-9.,]*[0-9]|[0-9])(?![0-9A-Za-z])"), F.lit(1))
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, r"[.,][0-9]{1,2}$", ""), r"[.,]", "")
    return F.transform(found, lambda x: F.concat(whole(x), F.when(x.rlike(r"[.,][0-9]{1,2}$"), F.concat(F.lit("."), F.regexp_extract(x, r"[.,]([0-9]{1,2})$", 1))).otherwise(F.lit(""))))


def digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def mod10_ok(number: Column) -> Column:
    """Weights 3 and 1 from the right, the last digit being the check digit."""
    d = F.reverse(digits(number))
    total = F.aggregate(F.transform(d, lambda x, i: x * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def s10_ok(number: Column) -> Column:
    """Nine digits between two letters and two letters: weights 8 6 4 2 3 5 9 7."""
    d = digits(F.substring(number, 3, 9))
    total = F.aggregate(F.zip_with(F.slice(d, 1, 8), F.array(*[F.lit(w) for w in (8, 6, 4, 2, 3, 5, 9, 7)]), lambda x, w: x * w), F.lit(0), lambda a, x: a + x)
    check = F.lit(11) - total % 11
    return F.coalesce(number.rlike(r"^[A-Z]{2}[0-9]{9}[A-Z]{2}$"), F.lit(False)) & (F.when(check == 10, 0).when(check == 11, 5).otherwise(check) == F.get(d, F.lit(8)))


def edits1(word: str, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> list[str]:
    """Strings one deletion, transposition, replacement or insertion away: what a misspelt query word may have been."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
    made |= {a + c + b[1:] for a, b in cut if b for c in alphabet} | {a + c + b for a, b in cut for c in alphabet}
    return sorted(made - {word})


def weighted_sum(d: Column, weights: tuple[int, ...]) -> Column:
    """Sum of digits times the weights, which repeat."""
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.transform(d, lambda x, i: x * F.get(w, i % len(weights))), F.lit(0), lambda a, x: a + x)


def fedex12_ok(number: Column) -> Column:
    """Eleven digits weighted 1, 3, 7 from the right; the sum mod 11 mod 10 is the twelfth."""
    d = digits(number)
    total = weighted_sum(F.reverse(F.slice(d, 1, 11)), (1, 3, 7))
    return F.coalesce(number.rlike(r"^[0-9]{12}$") & (total % 11 % 10 == F.get(d, F.lit(11))), F.lit(False))


def dhl10_ok(number: Column) -> Column:
    """The first nine digits mod 7 are the tenth."""
    nine = F.substring(number, 1, 9).try_cast("bigint")
    return F.coalesce(number.rlike(r"^[0-9]{10}$") & (nine % 7 == F.substring(number, 10, 1).try_cast("int")), F.lit(False))


def ups_ok(number: Column) -> Column:
    """1Z and 15 characters and a check digit: letters count (place after A + 2) mod 10, every second one doubled."""
    body = F.filter(F.split(F.substring(number, 3, 15), ""), lambda c: c != "")
    value = F.transform(body, lambda c, i: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise((F.ascii(c) - 63) % 10) * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(value, F.lit(0), lambda a, x: a + x)
    return F.coalesce(number.rlike(r"^1Z[0-9A-Z]{15}[0-9]$") & ((10 - total % 10) % 10 == F.substring(number, 18, 1).try_cast("int")), F.lit(False))


def codes(text: Column) -> Column:
    """One-time codes: four to eight digits near a word that says so; the first counts."""
    near = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(?:code|passcode|otp|pin)\b[^0-9\n]{0,40}\b([0-9]{4,8})\b", 1)
    return F.nullif(near, F.lit(""))


#: What stands before the total of a receipt, the most telling first, with its rank; the first that a line has counts.
TOTAL_LABELS = (
    ("grand total", 5), ("order total", 5), ("trip total", 5), ("total charged", 5), ("amount charged", 5), ("total paid", 5), ("amount paid", 5), ("you paid", 5), ("refund total", 5), ("refund of", 5), ("refunded", 4), ("total pagado", 5), ("importe total", 4), ("monto total", 4), ("total a pagar", 4),
    ("total amount", 4), ("payment amount", 4), ("charged to", 4), ("total", 3), ("amount due", 2), ("balance due", 2), ("charged", 2),
)
#: Lines that are about no total.
NO_TOTAL = ("subtotal", "sub-total", "sub total", "total savings", "total discount", "you saved", "total points", "total miles", "total distance", "total time")


def receipt_total(text: Column) -> Column:
    """The amount behind the most telling label: the last one of its line, or else of the next line that is not empty; the later line wins ties."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.trim(x) != "")
    pairs = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, after: F.struct(F.lower(x).alias("low"), x.alias("line"), after.alias("after")))

    def rank(low: Column) -> Column:
        ranked = F.coalesce(*[F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(k)}(?![\p{{L}}\p{{N}}])"), F.lit(r)) for k, r in TOTAL_LABELS], F.lit(0))
        return F.when(low.rlike("|".join(re.escape(x) for x in NO_TOTAL)), F.lit(0)).otherwise(ranked)

    last = lambda x: F.try_element_at(amounts(x), F.lit(-1))
    found = F.transform(pairs, lambda p, i: F.struct(rank(p["low"]).alias("rank"), i.alias("line"), F.coalesce(last(p["line"]), last(p["after"])).alias("amount")))
    fit = F.filter(found, lambda f: (f["rank"] > 0) & f["amount"].isNotNull())
    return F.array_max(fit)["amount"]


def snippet(toks: Column, word: str, size: int = 32) -> Column:
    """The ``size`` tokens around the first place of a word, which is marked; nothing if it does not occur."""
    at = F.array_position(toks, word)
    start = F.greatest(F.least(at - size // 2, F.size(toks) - size + 1), F.lit(1))
    return F.when(at > 0, F.array_join(F.transform(F.slice(toks, start.cast("int"), size), lambda t: F.when(t == word, F.concat(F.lit("<mark>"), t, F.lit("</mark>"))).otherwise(t)), " "))


def iso_dates(text: Column) -> Column:
    """Days written as 2026-10-02 that exist."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1)), lambda d: d.try_cast("date")), lambda d: d.isNotNull())
