"""Numbers, money, dates and chain references as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def half_up(x: Column) -> Column:
    """To a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def money_short(usd: Column) -> Column:
    """$1.23bn from a billion on, else whole millions."""
    return F.when(usd >= 1e9, F.format_string("$%.2fbn", usd / 1e9)).otherwise(F.format_string("$%dm", half_up(usd / 1e6)))


def money_repair(usd: Column) -> Column:
    return F.when(usd >= 1e9, F.format_string("$%.2fbn", usd / 1e9)).when(usd >= 1e6, F.format_string("$%dm", half_up(usd / 1e6))).otherwise(F.format_string("$%dk", half_up(usd / 1e3)))


def money_exact(usd: Column) -> Column:
    """Four decimals under a cent, else two."""
    return F.when((usd > 0) & (usd < 0.01), F.format_string("$%.4f", usd)).otherwise(F.format_string("$%.2f", usd))


def implied_usd(title: Column) -> Column:
    """The amount that a title states, as $1.2bn, $34m or $5k."""
    pattern = r"\$([0-9][0-9,]*(?:\.[0-9]+)?)\s?(bn|m|k)\b"
    number = F.regexp_replace(F.regexp_extract(title, pattern, 1), ",", "").try_cast("double")
    unit = F.regexp_extract(title, pattern, 2)
    return number * F.when(unit == "bn", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3)


def units(raw: Column, decimals: Column) -> Column:
    """Base units by the token's decimals."""
    return raw.cast("double") / F.pow(F.lit(10.0), decimals)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _add_word(limbs: Column, word: Column) -> Column:
    """limbs * 2^32 + word, for limbs of nine decimal digits, the least first. limb * 2^32 + carry stays under 2^63."""

    def next_limb(held: Column, limb: Column) -> Column:
        t = limb * F.lit(1 << 32) + held["carry"]
        return F.struct(_div(t, F.lit(10**9)).alias("carry"), F.concat(held["limbs"], F.array(t % F.lit(10**9).cast("long"))).alias("limbs"))

    start = F.struct(word.alias("carry"), F.array().cast("array<bigint>").alias("limbs"))
    return F.aggregate(limbs, start, next_limb, lambda held: held["limbs"])


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _digits_of(bare: Column) -> Column:
    """The decimal digits of up to 64 hexadecimal ones, without zeros in front."""
    padded = F.lpad(bare, 64, "0")
    words = F.transform(F.array(*map(F.lit, range(1, 65, 8))), lambda at: F.conv(F.substr(padded, at, F.lit(8)), 16, 10).cast("long"))
    limbs = F.aggregate(words, F.array_repeat(F.lit(0).cast("long"), 9), _add_word)  # 10^81 is over 2^256
    return F.ltrim(F.array_join(F.reverse(F.transform(limbs, lambda x: F.lpad(x.cast("string"), 9, "0"))), ""), F.lit("0"))


def hex_decimal(data: Column) -> Column:
    """The decimal digits of a hexadecimal number of up to 32 bytes, all of them; null where there is none. Zero is 0."""
    bare = F.regexp_replace(F.lower(data), "^0x0*", "")
    good = data.rlike(r"(?i)^0x[0-9a-f]+\z") & (F.length(bare) <= 64)
    return let(F.when(good, bare), lambda x: F.when(x == "", "0").when(x.isNotNull(), _digits_of(x)))


def hex_parts(data: Column, decimals: Column | int) -> Column:
    """struct(whole, rest): the digits before and after the point of a hexadecimal amount of base units."""
    decimals = F.lit(decimals) if isinstance(decimals, int) else decimals

    def cut(digits: Column) -> Column:
        padded = F.lpad(digits, F.greatest(F.length(digits), decimals + 1), F.lit("0"))  # a digit before the point at least
        place = F.greatest(F.length(digits), decimals + 1) - decimals
        return F.when(digits.isNotNull(), F.struct(F.substr(padded, F.lit(1), place).alias("whole"), F.substr(padded, place + 1, decimals).alias("rest")))

    return let(hex_decimal(data), cut)


def hex_units(data: Column, decimals: Column | int) -> Column:
    """A hexadecimal amount of up to 32 bytes in units of 10 ** decimals: whole units and the rest are taken apart before they are rounded. Null for what is no amount."""
    places = F.lit(decimals) if isinstance(decimals, int) else decimals
    scale = F.pow(F.lit(10.0), places)
    wide = let(hex_parts(data, decimals), lambda p: p["whole"].cast("double") + F.coalesce(F.nullif(p["rest"], F.lit("")).cast("double"), F.lit(0.0)) / scale)
    tens = F.get(F.array(*(F.lit(10**k).cast("long") for k in range(19))), places)
    short = F.regexp_extract(data, r"(?i)^0x0*([0-9a-f]{1,15})\z", 1)  # under 2^60: the same two parts in whole numbers of 64 bits

    def narrow(n: Column) -> Column:
        return _div(n, tens).cast("double") + (n % tens).cast("double") / scale

    number = let(short, lambda s: F.when((s != "") & places.between(0, 18), F.conv(s, 16, 10).cast("long")))
    return let(number, lambda n: F.when(n.isNotNull(), narrow(n)).otherwise(wide))


def chain_of_ref(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^([a-z]+):", 1)


def chain_ref(ref: Column) -> Column:
    """struct(chain, kind, id) of chain:kind:id; null if it is anything else."""
    pattern = r"^([a-z]+):([a-z]+):(.+)\z"
    return F.when(ref.rlike(r"^[a-z]+:[a-z]+:.+\z"), F.struct(*(F.regexp_extract(ref, pattern, k).alias(n) for k, n in enumerate(("chain", "kind", "id"), 1))))


def elide_hash(h: Column) -> Column:
    return F.when(F.length(h) > 14, F.concat(F.substring(h, 1, 8), F.lit("…"), F.substring(h, -4, 4))).otherwise(h)


def is_address(text: Column) -> Column:
    return text.rlike(r"(?i)^0x[0-9a-f]{40}\z")


def final(chain: Column, at: Column, now: Column) -> Column:
    """Whether a block is old enough on its chain; unknown chains, the future and times at or before 0 are not final."""
    held = F.create_map(*(F.lit(x) for pair in model.FINALITY_SECONDS.items() for x in pair))
    return F.coalesce((at > 0) & (at <= now) & (now - at >= held[chain]), F.lit(False))


def withheld_reason(chain: Column, at: Column, now: Column) -> Column:
    held = F.create_map(*(F.lit(x) for pair in model.FINALITY_SECONDS.items() for x in pair))
    return F.when(final(chain, at, now), None).when(held[chain].isNull(), "unknown chain").when(at.isNull() | (at <= 0), "no block time").when(at > now, "in the future").otherwise(F.format_string("%d s old, final at %d s", now - at, held[chain]))


def week_end(week: Column) -> Column:
    return F.date_add(week, 6)


def day_of_epoch(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def year_value(day: Column) -> Column:
    return F.year(day) + ((F.month(day) - 1) + (F.dayofmonth(day) - 1) / 31.0) / 12.0


def bucket_key(day: Column, bucket: str) -> Column:
    return F.date_format(day, "yyyy-MM" if bucket == "month" else "yyyy")


def period_label(day: Column, bucket: str) -> Column:
    return F.date_format(day, "MMM yyyy" if bucket == "month" else "yyyy")


def reward_after(epoch: Column) -> Column:
    """The block reward after so many halvings."""
    return 50.0 / F.pow(F.lit(2.0), epoch)


def halving_height(epoch: Column) -> Column:
    return epoch * 210_000


def content_hash(*parts: Column) -> Column:
    """SHA-256 over null-safe, length-separated parts."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def dedup_key(basis: Column) -> Column:
    """SHA-256 of a basis in lower case, with single spaces and without punctuation at its end."""
    return F.sha2(F.regexp_replace(F.trim(F.regexp_replace(F.lower(basis), r"\s+", " ")), r"[\s\p{Punct}]+\z", ""), 256)


def lock_key(slug: Column) -> Column:
    """A 32-bit signed hash: 31 times the hash so far and the next code unit."""
    codes = F.transform(F.filter(F.split(slug, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    full = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32)))
    return F.when(full >= 1 << 31, full - (1 << 32)).otherwise(full)


def projected(per_day: Column, subjects: Column, limit: Column) -> Column:
    """struct(requests, used, status): over a daily quota, tight from 0.8 of it on, ok, or unmetered without one."""
    requests = F.ceil(per_day * subjects)
    used = requests / limit
    return F.struct(requests.alias("requests"), F.round(used, 4).alias("used"), F.when(limit.isNull(), "unmetered").when(used > 1, "over").when(used >= 0.8, "tight").otherwise("ok").alias("status"))


def per_day(minutes: Column) -> Column:
    """Requests a day at one for each so many minutes, to one decimal."""
    return half_up(1440.0 / minutes * 10) / 10


def batched_tokens(chars: Column, items: Column, batch: int = 25) -> Column:
    """Tokens of a batched call: a third of the characters, and 200 for each batch."""
    return F.ceil(chars / 3.0) + F.ceil(items / batch) * 200


def vote_outcome(choices: Column, scores: Column) -> Column:
    """struct(choice, outcome) of a closed vote; null for a tie, for other numbers of scores, or without any votes."""
    top = F.array_max(scores)
    single = F.size(F.filter(scores, lambda s: s == top)) == 1
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    choice = F.get(choices, (F.array_position(scores, top) - 1).cast("int"))
    outcome = F.when(choice.rlike(r"(?i)^(yes|yae|yea|for|approve|accept|in favou?r)\b"), "passed").when(choice.rlike(r"(?i)^(no|nay|against|reject|abstain)\b"), "rejected").otherwise("decided")
    return F.when((F.size(choices) == F.size(scores)) & (total > 0) & single, F.struct(choice.alias("choice"), outcome.alias("outcome")))
