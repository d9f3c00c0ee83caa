"""Personal data replaced by format-preserving Feistel pseudonyms, with DataFrame functions only.

Numbers and dates are found by pattern and validated (card checksums, IBAN checksums, ranges of social security numbers,
addresses and calendar dates). A keyed Feistel network permutes each within its own format, so the result is valid again,
separators stay, lengths too but for IPv4 addresses, and equal values get equal pseudonyms in all documents:

- payment cards: the digits before the check digit, under a new check digit
- IBANs: the digits and letters behind the check digits, each kind in its places, under new check digits
- social security numbers, by the valid areas, groups and serials
- phone numbers, all digits but the country code's behind a plus sign; area codes are not validated
- dates between 1800-01-01 and 2199-12-31, by the day's number
- IPv4 addresses, all 32 bits: the new octets may have more or fewer digits
- hexadecimal keys of 32 digits and more, digit by digit; runs of 13 to 19 digits that fail the card checksum stay
- e-mail addresses, in lower case: the letters and the digits, each kind in its places, of all but the last label; the digits
  depend on the letters, too. A local part of over 64 or a label of over 63 characters makes no address; of a domain the
  first 127 labels are taken

The key is the caller's: an argument, or the session's setting KEY_SETTING. There is none in the code; the registered
query and the pipeline draw a random one for a session that sets none, so their pseudonyms link values within the session.

The network has eight rounds over two parts a and b of a mixed-radix number: a = (a + F(b)) mod A, then b = (b + F(a))
mod B, with F from SHA-256 over key, format, what the value depends on, sizes, round and the other part. A single digit or
letter has no two parts: it is a number of a slightly larger pair of sizes, permuted until it falls into its range again.

Patterns take time in proportion to the text: what repeats is possessive or bounded and begins at one place of a run, so no
match goes back over a long run and none is nested deeper than a domain's labels.

Defined results: null and empty texts stay as they are; values that fail their validation stay; repeated rows get the same
result; nulls in other columns do not matter; an empty table gives no rows; columns of the input keep their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm.host_rules import let

#: Spark redacts settings with this ending from its logs.
KEY_SETTING = "spark.lodestar.pseudonym.secret"
ROUNDS = 8
# The formats, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}+"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
HEX = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, IBAN, HEX, IPV4, DATE, SSN, PHONE, CARD))


def session_key(spark: SparkSession) -> str:
    """The session's key; a random one, kept for the session, where none is set."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def keyed(key: str, kind: str, round_no: Column, salt: Column, part: Column) -> Column:
    """A 56-bit keyed number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), round_no.cast("string"), F.lit("|"), salt, F.lit("|"), part.cast("string")), 256), 1, 14), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column | int, size_b: Column | int, key: str, kind: str, tweak: Column | None = None, walk: tuple[int, int] | None = None) -> Column:
    """Permutes the pairs of [0, A) x [0, B); a struct of a and b. Keyed by format, tweak and sizes. walk: (n, times), to
    go through the network again, up to so many times in all, while the pair's number a B + b is not below n."""
    size_a, size_b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (size_a, size_b))
    salt = F.concat_ws("|", F.lit("") if tweak is None else tweak, size_a.cast("string"), size_b.cast("string"))
    names = ("size_a", "size_b", "salt", "done")
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), size_a.alias("size_a"), size_b.alias("size_b"), salt.alias("salt"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        same = [s[c].alias(c) for c in names]
        even = F.struct(F.pmod(s["a"] + keyed(key, kind, k, s["salt"], s["b"]), s["size_a"]).alias("a"), s["b"].alias("b"), *same)
        odd = F.struct(s["a"].alias("a"), F.pmod(s["b"] + keyed(key, kind, k, s["salt"], s["a"]), s["size_b"]).alias("b"), *same)
        return F.when(k % 2 == 0, even).otherwise(odd)

    if walk is None:
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step)

    def walked(s: Column, k: Column) -> Column:
        done = s["done"] | ((k > 0) & (k % ROUNDS == 0) & (s["a"] * s["size_b"] + s["b"] < walk[0]))
        held = F.struct(*[s[c].alias(c) for c in ("a", "b", *names[:-1])], F.lit(True).alias("done"))
        return F.when(done, held).otherwise(step(s, k % ROUNDS))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * walk[1] - 1)), state, walked)


#: Sizes of two parts whose pairs hold a single digit of a radix.
SINGLE = {10: (4, 3), 16: (4, 4), 26: (9, 3)}


def permute_single(number: Column, key: str, kind: str, radix: int, tweak: Column) -> Column:
    """A permutation of [0, radix): the network over a pair that holds it, again while the result is outside. The pairs
    outside are few, and a walk meets each of them once at most."""
    size_a, size_b = SINGLE[radix]
    out = feistel(F.floor(number / size_b), F.pmod(number, F.lit(size_b)), size_a, size_b, key, f"{kind}-one", tweak, (radix, size_a * size_b - radix + 1))
    return let(out, lambda s: s["a"] * size_b + s["b"])


def permute_digits(digits: Column, key: str, kind: str, radix: int = 10, tweak: Column | None = None) -> Column:
    """A permutation of the digit strings of each length; longer ones than 24 (22 beyond radix 16) in blocks of that. tweak:
    what the permutation depends on besides."""
    tweak = F.lit("") if tweak is None else tweak
    number = lambda s: F.coalesce(F.conv(s, radix, 10).cast("long"), F.lit(0))
    text = lambda n, width: F.when(width > 0, F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), width, "0")).otherwise("")
    size = lambda n: F.pow(F.lit(float(radix)), n).cast("long")

    def whole(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")

        def run(p: Column) -> Column:
            out = feistel(number(p["x"]), number(p["y"]), size(F.length(p["x"])), size(F.length(p["y"])), key, kind, tweak)
            return let(F.struct(out.alias("o"), p["x"].alias("x"), p["y"].alias("y")), lambda r: F.concat(text(r["o"]["a"], F.length(r["x"])), text(r["o"]["b"], F.length(r["y"]))))

        single = text(permute_single(number(d), key, kind, radix, tweak), F.lit(1))
        return F.when(F.length(d) == 1, single).otherwise(let(F.struct(F.substr(d, F.lit(1), half).alias("x"), F.substr(d, half + 1).alias("y")), run))

    block = 24 if radix <= 16 else 22  # a half's numbers are exact in a double
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(digits) - 1) / block).cast("int"))), lambda k: let(F.substr(digits, k * block + 1, F.lit(block)), whole))
    return F.array_join(parts, "")


_LETTERS, _AS_NUMBERS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def permute_letters(letters: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of small letters of each length."""
    return F.translate(permute_digits(F.translate(letters, _LETTERS, _AS_NUMBERS), key, kind, 26), _AS_NUMBERS, _LETTERS)


def into_places(shape: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """Puts digits, one after another, into the places of shape that hold digits (or another kind of characters)."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike(kind), F.struct(F.concat(a["s"], F.substr(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
        lambda a: a["s"],
    )


def luhn_digit(body: Column) -> Column:
    """The check digit for the digits before it."""
    sums = F.aggregate(
        F.split(F.reverse(body), ""),
        F.struct(F.lit(0).alias("t"), F.lit(True).alias("twice")),
        lambda a, c: F.struct((a["t"] + F.when(a["twice"], F.pmod(2 * c.cast("int"), F.lit(10)) + F.floor(2 * c.cast("int") / 10).cast("int")).otherwise(c.cast("int"))).alias("t"), (~a["twice"]).alias("twice")),
        lambda a: a["t"],
    )
    return F.pmod(F.lit(10) - F.pmod(sums, F.lit(10)), F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """The remainder by 97 of the number that a text of digits and capital letters (A = 10) spells."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _card(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        valid = luhn_digit(body) == F.right(d, F.lit(1))
        new = F.when(valid, let(permute_digits(body, key, "card"), lambda p: F.concat(p, luhn_digit(p))))
        return let(new, lambda n: F.coalesce(into_places(m, n), m))

    return let(F.regexp_replace(m, "[^0-9]", ""), run)


def _iban(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        country, body = F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(5))
        digits = permute_digits(F.regexp_replace(body, "[^0-9]", ""), key, "iban")
        capitals = F.upper(permute_letters(F.lower(F.regexp_replace(body, "[^A-Z]", "")), key, "iban-letters"))
        new = let(digits, lambda n: into_places(body, n))
        letters = let(F.struct(new.alias("n"), capitals.alias("c")), lambda x: into_places(x["n"], x["c"], "[A-Z]"))
        check = let(letters, lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        spaced = let(check, lambda x: F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), lambda a, c: F.when(c == " ", F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))).otherwise(F.struct(F.concat(a["s"], F.substr(x, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))), lambda a: a["s"]))
        return F.when(mod97(F.concat(body, F.substr(d, F.lit(1), F.lit(4)))) == 1, spaced).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), run)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    ordinal = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(ordinal, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    back = lambda s: F.concat(F.lpad(F.when(s["a"] + 1 >= 666, s["a"] + 2).otherwise(s["a"] + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.pmod(s["b"], F.lit(9999)) + 1).cast("string"), 4, "0"))
    return F.when(valid, let(out, back)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """146097 days = 189 * 773, the length of the calendar's cycle."""

    def run(d: Column) -> Column:
        n = F.datediff(d, F.lit("1800-01-01").cast("date"))
        out = feistel(F.floor(n / 773), F.pmod(n, F.lit(773)), 189, 773, key, "date")
        moved = let(out, lambda s: F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (s["a"] * 773 + s["b"]).cast("int")), "yyyy-MM-dd"))
        return F.when((n >= 0) & (n < 146097), moved).otherwise(m)

    return let(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"), run)


def _ipv4(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        n = F.transform(p, lambda x: x.cast("int"))
        valid = F.forall(n, lambda x: x < 256)
        out = feistel(F.get(n, F.lit(0)) * 256 + F.get(n, F.lit(1)), F.get(n, F.lit(2)) * 256 + F.get(n, F.lit(3)), 65536, 65536, key, "ipv4")
        whole = lambda x: F.floor(x / 256).cast("string")
        rest = lambda x: F.pmod(x, F.lit(256)).cast("string")
        return F.when(valid, let(out, lambda s: F.concat_ws(".", whole(s["a"]), rest(s["a"]), whole(s["b"]), rest(s["b"])))).otherwise(m)

    return let(F.split(m, r"\."), run)


def _email(m: Column, key: str) -> Column:
    """All but the last label, as one word of letters and one of digits; the address is told apart without case."""

    def run(found: Column) -> Column:
        lead = F.regexp_extract(found, r"^[._%+-]*+", 0)
        return F.concat(lead, let(F.substr(found, F.length(lead) + 1), address))

    def address(x: Column) -> Column:
        head, tail = F.regexp_extract(x, r"^(.*)\.[^.]*$", 1), F.regexp_extract(x, r"(\.[^.]*)$", 1)
        letters = permute_letters(F.regexp_replace(head, "[^a-z]", ""), key, "email")
        digits = permute_digits(F.regexp_replace(head, "[^0-9]", ""), key, "email-digits", tweak=F.regexp_replace(x, "[0-9]", "0"))
        filled = let(F.struct(digits.alias("d"), letters.alias("l")), lambda n: let(into_places(head, n["d"]), lambda h: into_places(h, n["l"], "[a-z]")))
        return F.concat(filled, tail)

    return let(F.lower(m), run)


def _phone(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        digits = permute_digits(F.regexp_replace(p["rest"], "[^0-9]", ""), key, "phone", tweak=p["code"])
        return F.concat(p["code"], let(digits, lambda n: into_places(p["rest"], n)))

    code = F.regexp_extract(m, COUNTRY, 0)
    return let(F.struct(code.alias("code"), F.substr(m, F.length(code) + 1).alias("rest")), run)


def _hex(m: Column, key: str) -> Column:
    new = permute_digits(F.lower(m), key, "hex", 16)
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.contains("@"), "email").when(whole(IBAN), "iban").when(whole(HEX), "hex").when(whole(IPV4), "ipv4").when(whole(DATE), "date").when(whole(SSN), "ssn").when(whole(PHONE), "phone").otherwise("card")


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself where its validation fails."""

    def run(k: Column) -> Column:
        cases = {"email": _email, "iban": _iban, "hex": _hex, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone}
        out = F.when(k == "card", _card(m, key))
        for name, f in cases.items():
            out = out.when(k == name, f(m, key))
        return out

    return let(kind_of(m), run)


def found_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)


def replace_values(text: Column, found: Column, new: Column) -> Column:
    """The text between the values, and the new values, by turns."""
    between = F.split(text, ANY, -1)
    return F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` replaced and the column `_n_values` of values changed in it."""
    if not key:
        raise ValueError("pseudonyms need a key")
    body = F.col(f"`{text}`")
    # texts without an address sign, a digit pair or a long run of hexadecimal digits can't hold any value
    found = F.when(body.rlike("@|[0-9][0-9. -]?[0-9]|[0-9A-Fa-f]{32}"), found_values(body))

    def run(m: Column) -> Column:
        new = F.transform(m, lambda x: pseudonym(x, key))
        return let(new, lambda n: F.struct(replace_values(body, m, n).alias("text"), F.size(F.filter(F.zip_with(m, n, lambda a, b: a != b), lambda c: c)).cast("long").alias("n")))

    both = docs.withColumn("_new", F.when(F.size(found) > 0, let(found, run)))
    return both.withColumns({text: F.coalesce("_new.text", body), "_n_values": F.coalesce("_new.n", F.lit(0).cast("long"))}).drop("_new")


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with their own columns; n_chars follows the text."""
    out = pseudonymise(_shared.wrapped(docs, text=F.col(f"`{text}`")), key)
    new = {text: F.col("text")} | ({"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _shared.unwrapped(out, docs.columns, **new)


def op6_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(_shared.table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.select("doc_id", "text", F.col("_n_values").alias("n_values"))
