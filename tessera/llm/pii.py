"""Format-preserving pseudonyms for personal data.

Validated numbers, addresses and dates are permuted by a keyed Feistel network
over their own format: a card number becomes a card number with a right check
digit, a date a date, and equal values become equal pseudonyms in every
document. All of it is built-in expressions. The key comes to them as the value
of a scalar subquery, so that no plan, log or page shows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Name of the session setting that holds the key, one that Spark's default redaction covers.
KEY_SETTING = "tessera.pii.secret"
#: What the registered query takes where the setting is missing, so that it runs on public test tables; no operator does.
QUERY_KEY = "public-test-tables"
ROUNDS = 8
#: Characters of a chunk: half of one has to fit 63 bits in base 36.
CHUNK = 20

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
#: Eight groups, or fewer around a double colon.
_IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
_DATE = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])"
#: Day, month, year; with slashes month, day, year, unless the first is over 12; year, month, day with slashes.
_DATES = r"(?<![\w./-])(?:\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{1,2}/\d{1,2})(?![\w/-]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_CARD = r"(?<![\w-])(?:\d{4}[ -]){3}\d{1,7}(?![\w-])|(?<![\w-])\d{4}[ -]\d{6}[ -]\d{5}(?![\w-])|(?<![\w-])\d{13,19}(?![\w-])"
_NATIONAL = r"(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
#: Looks back on 7 to 15 digits behind a plus, written out: a look-behind takes no repeated groups of open length.
_COUNTED = r"(?<=\+" + r"\d[ .()-]{0,3}" * 7 + r"(?:\d[ .()-]{0,3})?" * 8 + ")"
#: What a group behind seven digits of a phone number must not begin: another value, a decimal, a time.
_NEXT = rf"(?:{_IP}|{_DATE}|{_SSN}|(?:{_CARD})(?![ -]\d{{4}}(?!\w))|{_NATIONAL}|(?<= )\d{{1,4}}(?:[,:/]\d|\.\d(?!\d)))"
_GROUP = rf"[ .-](?!{_COUNTED}{_NEXT})\d{{2,4}}"
_ABROAD = rf"(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:{_GROUP}){{1,3}}(?!\w)"
#: Country codes whose numbers have ten digits: a further group behind a space is no part of them.
_TEN = r"(?![.-]\d)(?<=\+(?:1|7|44)(?:[ .-]?\(0\))?" + r"[ .()-]{0,3}\d" * 10 + ")"
#: Each alternative tries fewer groups until the count of digits is right; a number has 7 to 15.
_PHONE = rf"{_ABROAD}{_TEN}|{_ABROAD}{_COUNTED}|(?<![\w+])\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}(?!\w)|{_NATIONAL}"
_SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
#: Keys and tokens of public services, by the prefixes that they document.
_PREFIX = r"(?:AKIA|ASIA|gh[opsur]_|sk-|xox[abprs]-|AIza|eyJ)"
_TOKEN = (
    r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,251}|sk-[0-9A-Za-z_-]{20,200}|xox[abprs]-[0-9A-Za-z-]{10,200}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,2000}\.eyJ[0-9A-Za-z_-]{10,4000}\.[0-9A-Za-z_-]{10,1000})(?![0-9A-Za-z_-])"
)
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9a-z])"
#: Characters of an IBAN by country, as the registry of ISO 13616 has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
#: One pass over a text finds all kinds; the earlier alternative wins.
PATTERN = "|".join([_EMAIL, _TOKEN, _SECRET, _IBAN, _IP6, _IP, _DATE, _DATES, _SSN, _CARD, _PHONE])
#: Areas, groups and serial numbers of social security numbers that are given out: 001 to 899 without 666, 01 to 99, 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999
#: Days of the dates that are permuted, 1900-01-01 to 2099-12-31: 319 * 229.
_DAYS_A, _DAYS_B = 319, 229


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prf(key: str, tweak: str, i: str, value: str) -> str:
    """60 keyed bits of a round and a half."""
    said = f"concat_ws('|', {key}, {tweak}, {i}, {value})"
    return f"cast(conv(substring(sha2(concat({key}, sha2({said}, 256)), 256), 1, 15), 16, 10) as bigint)"


def feistel(a: str, b: str, size_a: str, size_b: str, key: str, tweak: str) -> str:
    """SQL for struct(a, b) after an even number of rounds over halves of ``size_a`` and ``size_b`` values: a permutation."""
    modulus = f"if(i % 2 = 0, {size_a}, {size_b})"
    step = f"named_struct('a', s.b, 'b', pmod(s.a + pmod({_prf(key, tweak, 'i', 's.b')}, {modulus}), {modulus}))"
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step})"


def _power(radix: int, n: str) -> str:
    return f"cast(round(power({radix}D, {n})) as bigint)" if radix == 10 else f"aggregate(sequence(1, {n} + 1), 1L, (p, j) -> if(j > {n}, p, p * {radix}L))"


def _chunk(text: str, radix: int, key: str, tweak: str) -> str:
    """SQL for a digit string in base ``radix``, at most CHUNK long, as another of its length."""
    value = lambda x: f"coalesce(cast(conv(nullif({x}, ''), {radix}, 10) as bigint), 0L)"
    back = lambda x, n: f"lpad(lower(conv(cast({x} as string), 10, {radix})), {n}, '0')"
    body = _let(
        "named_struct('n', length(c), 'u', length(c) div 2)",
        "z",
        _let(
            feistel(
                value("substring(c, 1, z.u)"), value("substring(c, z.u + 1)"), _power(radix, "z.u"), _power(radix, "(z.n - z.u)"),
                key, f"concat({tweak}, z.n)",
            ),
            "r",
            f"concat(if(z.u > 0, {back('r.a', 'z.u')}, ''), {back('r.b', '(z.n - z.u)')})",
        ),
    )
    return f"if({text} = '', '', {_let(text, 'c', body)})"


def permuted(text: str, radix: int, key: str, tweak: str) -> str:
    """SQL for any digit string, chunk by chunk."""
    part = _chunk(f"substring(t, 1 + {CHUNK} * k, {CHUNK})", radix, key, f"concat({tweak}, '/', k, '/')")
    return _let(text, "t", f"array_join(transform(sequence(0, (greatest(length(t), 1) - 1) div {CHUNK}), k -> {part}), '')")


def _refill(shape: str, digits: str, pattern: str) -> str:
    """SQL for ``shape`` with the characters that match ``pattern`` replaced by ``digits`` in turn."""
    step = f"if(x rlike '^{pattern}$', named_struct('o', concat(s.o, substring(d, s.n, 1)), 'n', s.n + 1), named_struct('o', concat(s.o, x), 'n', s.n))"
    return _let(digits, "d", f"aggregate(split({shape}, ''), named_struct('o', '', 'n', 1), (s, x) -> {step}, s -> s.o)")


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum of a digit string, the last digit counting once."""
    twice = "if(i % 2 = 1, int(substring(v, i, 1)), 2 * int(substring(v, i, 1)) - if(int(substring(v, i, 1)) > 4, 9, 0))"
    return _let(f"reverse({digits})", "v", f"aggregate(sequence(1, length(v)), 0, (q, i) -> q + {twice})")


def _octets(m: str) -> str:
    return f"transform(split({m}, '[.]'), o -> int(o))"


def _mod97(text: str) -> str:
    """SQL for digits and capitals, the latter as 10 to 35, modulo 97."""
    step = "if(c rlike '[0-9]', (q * 10 + int(c)) % 97, (q * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({text}, ''), 0, (q, c) -> int({step}))"


def _iban(m: str, key: str) -> str:
    """SQL for a match as an IBAN of its country's length with what follows it; its letters stay, its digits are permuted."""
    lengths = "map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items()) + ")"
    shape = _let(f"coalesce({lengths}[substring({m}, 1, 2)], 99)", "n", f"regexp_extract({m}, concat('^(?:[0-9A-Z] ?){{', n - 1, '}}[0-9A-Z]'), 0)")
    body = "substring(regexp_replace(h, ' ', ''), 5)"
    inner = _refill("b", permuted("regexp_replace(b, '[^0-9]', '')", 10, key, "'iban'"), "[0-9]")
    made = _let(inner, "p", f"concat(substring({m}, 1, 2), lpad(string(98 - {_mod97(f"concat(p, substring({m}, 1, 2), '00')")}), 2, '0'), p)")
    valid = f"{_mod97("concat(b, substring(h, 1, 4))")} = 1"
    changed = f"concat({_refill('h', made, '[0-9A-Z]')}, substring({m}, length(h) + 1))"
    return _let(shape, "h", f"if(h = '', {m}, {_let(body, 'b', f"if({valid}, {changed}, {m})")})")


def _ip6(m: str, key: str) -> str:
    """SQL for an address in full, its 128 bits permuted."""
    groups = lambda part: f"filter(split({part}, ':'), g -> g <> '')"
    pads = lambda gs: f"array_join(transform({gs}, g -> lpad(lower(g), 4, '0')), '')"
    whole = _let(groups(f"substring_index({m}, '::', 1)"), "l", _let(f"if({m} like '%::%', {groups(f"substring_index({m}, '::', -1)")}, array())", "r", f"rpad({pads('l')}, 32 - 4 * size(r), '0') || {pads('r')}"))
    out = _let(permuted("w", 16, key, "'ip6'"), "p", "array_join(transform(sequence(0, 7), i -> regexp_replace(substring(p, 1 + 4 * i, 4), '^0{1,3}', '')), ':')")
    return f"if(size({groups(m)}) between 3 and if({m} like '%::%', 7, 8), {_let(whole, 'w', out)}, {m})"


def _dates(m: str, day: str) -> str:
    """SQL for a date with dots or slashes, in the same order and with zeros where it has them; ``day`` permutes n to a date's text."""
    order = f"case when f[0] rlike '^....$' then array(0, 1, 2) when {m} like '%.%' or int(f[0]) > 12 then array(2, 1, 0) else array(2, 0, 1) end"
    found = "try_cast(concat_ws('-', f[o[0]], lpad(f[o[1]], 2, '0'), lpad(f[o[2]], 2, '0')) as date)"
    # A part without a zero before it may need two places.
    spelled = "transform(f, (x, i) -> element_at(transform(array(string(int(split(d, '-')[int(array_position(o, i)) - 1]))), v -> lpad(v, greatest(length(v), length(x)), '0')), 1))"
    made = _let(day, "d", f"array_join({spelled}, if({m} like '%.%', '.', '/'))")
    numbered = _let(f"datediff({found}, date'1900-01-01')", "n", f"if(n between 0 and {_DAYS_A * _DAYS_B - 1}, {made}, {m})")
    return _let(f"split({m}, '[./]')", "f", _let(order, "o", numbered))


def _ssn(m: str, key: str) -> str:
    """SQL for a number that was given out, as another such; others stay."""
    area, group, serial = f"int(substring({m}, 1, 3))", f"int(substring({m}, 5, 2))", f"int(substring({m}, 8))"
    index = f"({area} - if({area} > 666, 2, 1)) * {_GROUPS} + {group} - 1"
    moved = feistel(index, f"{serial} - 1", f"{_AREAS * _GROUPS}L", f"{_SERIALS}L", key, "'ssn'")
    part = lambda x, n: f"lpad(string({x}), {n}, '0')"
    again = _let(f"r.a div {_GROUPS}", "i", part("i + if(i > 664, 2, 1)", 3))
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {_let(moved, 'r', f"concat_ws('-', {again}, {part(f'r.a % {_GROUPS} + 1', 2)}, {part('r.b + 1', 4)})")}, {m})"


def _cases(m: str, key: str) -> list[tuple[str, str]]:
    """Kind, as SQL over a match, and its pseudonym; a match that fits no kind or fails its validation stays."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    card = _let(
        permuted("substring(d, 1, length(d) - 1)", 10, key, "'card'"), "p",
        f"concat(p, string(pmod(10 - {_luhn("concat(p, '0')")} % 10, 10)))",
    )
    ip = _let(
        feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536L", "65536L", key, "'ip'"), "r",
        "concat_ws('.', r.a div 256, r.a % 256, r.b div 256, r.b % 256)",
    )
    day = _let(
        feistel(f"n div {_DAYS_B}", f"n % {_DAYS_B}", f"{_DAYS_A}L", f"{_DAYS_B}L", key, "'date'"), "r",
        f"string(date_add(date'1900-01-01', int(r.a * {_DAYS_B} + r.b)))",
    )
    local = f"substring_index({m}, '@', 1)"
    mail = f"concat({_refill(local, permuted(f"lower(regexp_replace({local}, '[^A-Za-z0-9]', ''))", 36, key, "'mail'"), '[A-Za-z0-9]')}, '@', substring_index({m}, '@', -1))"
    # Both spellings have one pseudonym; of a mixed one, capitals stand where they stood.
    secret = _let(
        permuted(f"lower({m})", 16, key, "'secret'"), "p",
        f"case when {m} = lower({m}) then p when {m} = upper({m}) then upper(p) "
        f"else array_join(zip_with(split({m}, ''), split(p, ''), (a, b) -> if(a rlike '[A-F]', upper(b), b)), '') end",
    )
    date = f"try_cast({m} as date)"
    country = f"regexp_extract({m}, '^[+][0-9]{{1,3}}', 0)"
    rest = f"substring({m}, length({country}) + 1)"
    phone = f"concat({country}, {_refill(rest, permuted(f"regexp_replace({rest}, '[^0-9]', '')", 10, key, "'phone'"), '[0-9]')})"
    token = _let(
        f"regexp_extract({m}, '^{_PREFIX}', 0)", "h",
        _let(f"substring({m}, length(h) + 1)", "t0", f"concat(h, {_let(_refill('t0', permuted("lower(regexp_replace(t0, '[^0-9A-Za-z]', ''))", 36, key, "'token'"), '[0-9A-Za-z]'), 'p', 'if(t0 = upper(t0), upper(p), p)')})"),
    )
    return [
        (f"contains({m}, '@')", mail),
        (f"{m} rlike '^{_PREFIX}' and not {m} rlike '^[0-9A-Fa-f]{{32,64}}$'", token),
        (f"{m} rlike '^[0-9A-Fa-f]{{32,64}}$'", secret),
        (f"{m} rlike '^[A-Z]{{2}}[0-9]{{2}}'", _iban(m, key)),
        (f"{m} rlike '^[0-9A-Fa-f]{{1,4}}:'", _ip6(m, key)),
        (f"{m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'", _let(_octets(m), "o", f"if(array_max(o) < 256, {ip}, {m})")),
        (f"{m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'", _let(f"datediff({date}, date'1900-01-01')", "n", f"if(n between 0 and {_DAYS_A * _DAYS_B - 1}, {day}, {m})")),
        (f"{m} rlike '^[0-9]{{1,4}}([./])[0-9]{{1,2}}[./][0-9]{{1,4}}$'", _dates(m, day)),
        (f"{m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'", _ssn(m, key)),
        (f"{m} rlike '^[0-9][0-9 -]{{11,}}[0-9]$' and not {m} rlike '^[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}$'", _let(digits, "d", f"if(length(d) between 13 and 19 and {_luhn('d')} % 10 = 0, {_refill(m, card, '[0-9]')}, {m})")),
        (f"length({digits}) between 7 and 15", phone),
    ]


def pseudonym(match: str, key: str) -> str:
    return "case " + " ".join(f"when {test} then {value}" for test, value in _cases(match, key)) + f" else {match} end"


def pseudonymised(documents: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``documents`` with personal data in ``text`` replaced, and ``n_replaced``.

    The key is the session setting KEY_SETTING unless given; without either this
    raises. Values that look like personal data but fail validation (check digits,
    octets, calendar, numbers never given out) stay. Null stays null with 0
    replaced, an empty text stays empty, a text of any length is searched whole by
    one task. Repeated rows get equal results; an empty table gives no row; other
    columns are kept whatever their names, a column n_replaced is replaced.
    """
    spark = documents.sparkSession
    key = key if key is not None else spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to the key of the pseudonyms")
    rest = [F.col(f"`{c.replace("`", "``")}`") for c in documents.columns if c not in (text, "n_replaced")]
    kept = [F.struct(*rest).alias("_row")] if rest else []
    secret = spark.createDataFrame([(key,)], "k string").scalar().alias("_key")
    step = documents.select(*kept, F.col(f"`{text}`").alias("_text"), secret)
    step = step.withColumn("_found", F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)))
    step = step.withColumn("_new", F.expr(f"transform(_found, m -> {pseudonym('m', '_key')})"))
    pieces = F.zip_with(F.split("_text", PATTERN, -1), "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
    plain = F.col("_text").isNull() | (F.size("_found") <= 0)
    return step.select(
        *(["_row.*"] if rest else []),
        F.when(plain, F.col("_text")).otherwise(F.array_join(pieces, "")).alias(text),
        F.when(plain, 0).otherwise(changed).cast("long").alias("n_replaced"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(documents, spark.conf.get(KEY_SETTING, QUERY_KEY)).select("doc_id", "text", "n_replaced")


QUERIES = {"op4_pii": op4_pii}
