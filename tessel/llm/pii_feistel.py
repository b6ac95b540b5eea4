"""PII: format-preserving Feistel pseudonyms (DataFrame functions only).

What is recognised, in this order at each place: e-mail addresses; IPv4 addresses (each part at most 255);
secrets of 32 or more hexadecimal digits; dates yyyy-mm-dd, dd.mm.yyyy and dd/mm/yyyy that exist between
1900-01-01 and 2100-05-01; social security numbers (3-2-4 with issuable groups); telephone numbers; card numbers in
groups; runs of 9 or more digits.  A candidate that fails its validation stays as it is, save for digit runs, which are
permuted as plain numbers.

Each kind is permuted inside its own format: a keyed two-part Feistel network over Z_a x Z_b with a * b exactly the
number of valid values (70 x 271 ... days, 2^32 addresses, 10^n digits), so a pseudonym is again valid, different values stay
different and equal values stay linked across documents.  Numbers of 13 to 19 digits that pass Luhn's test are permuted among those that do, all
others among those that do not.  E-mail parts and secrets become keyed digests (48 bits and more) in their format.

The key has no fixed default: it is ``pseudonymise``'s argument or the session's ``spark.tessel.pii.secret``, else one drawn for this process, so
pseudonyms agree between runs only where a key is given.

Defined results: a null text stays null with 0 found; an empty one stays empty; repeated rows give equal rows; other
columns pass through (a column named ``n_private`` is replaced); an empty table gives an empty result.  Digit runs over 36 digits are permuted in pieces of 18.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
ISO = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])"
DMY = r"(?<![0-9A-Za-z./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9A-Za-z]|[./][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9])"
RUN = r"(?<![0-9])[0-9]{9,}+"
PRIVATE = "|".join((EMAIL, IPV4, SECRET, ISO, DMY, SSN, PHONE, CARD, RUN))
ROUNDS = 8
DAYS_A, DAYS_B = 270, 271


def _lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round(key: str, tag: str, i: str, v: str) -> str:
    return f"cast(conv(substring(sha2(concat_ws('|', {_lit(key)}, {tag}, {i}, {v}), 256), 1, 15), 16, 10) as bigint)"


def feistel(x: str, y: str, a: str, b: str, key: str, tag: str) -> str:
    """SQL for struct(x, y): the keyed permutation of Z_a x Z_b applied to (x, y), all bigint, a and b at most 10^18."""
    new_y = f"pmod(s.y + pmod({_round(key, tag, 'i', 's.x')}, {b}), {b})"
    new_x = f"pmod(s.x + pmod({_round(key, tag, 'i', 's.y')}, {a}), {a})"
    step = f"if(i % 2 = 0, named_struct('x', s.x, 'y', {new_y}), named_struct('x', {new_x}, 'y', s.y))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint)), (s, i) -> {step})"


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it in ``body`` as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digits(d: str, key: str, tag: str = "'n'") -> str:
    """A string of 1 to 36 digits, permuted among those of its length."""
    half = f"(length({d}) div 2)"
    lo = f"cast(coalesce(nullif(substring({d}, 1, {half}), ''), '0') as bigint)"
    hi = f"cast(substring({d}, {half} + 1) as bigint)"
    a, b = f"cast(rpad('1', cast({half} as int) + 1, '0') as bigint)", f"cast(rpad('1', cast(length({d}) - {half} as int) + 1, '0') as bigint)"
    sure = f"concat({tag}, length({d}))"
    return let(feistel(lo, hi, a, b, key, sure), "r", f"concat(if({half} = 0, '', lpad(cast(r.x as string), cast({half} as int), '0')), lpad(cast(r.y as string), cast(length({d}) - {half} as int), '0'))")


def luhn_sum(d: str) -> str:
    """Luhn's sum of a digit string whose last digit counts once."""
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if((length({d}) - i) % 2 = 1, cast(substring('0246813579', cast(substring({d}, i, 1) as int) + 1, 1) as int), cast(substring({d}, i, 1) as int)))"


def check_digit(body: str) -> str:
    """The digit that makes ``body`` with it pass Luhn's test."""
    return f"pmod(10 - {luhn_sum(f'concat({body}, 0)')} % 10, 10)"


def no_card(d: str, key: str) -> str:
    """A string of 13 to 19 digits that fails Luhn's test, permuted among those of its length: its last digit is 1 to 9 above the check digit."""
    rest = f"(length({d}) - 1 - length({d}) div 2)"
    body = f"substring({d}, 1, length({d}) - 1)"
    above = f"pmod(cast(right({d}, 1) as int) - {check_digit(body)}, 10)"
    hi = f"cast(left({d}, cast(length({d}) div 2 as int)) as bigint)"
    lo = f"cast(substring({body}, cast(length({d}) div 2 as int) + 1) as bigint) * 9 + {above} - 1"
    a, b = f"cast(rpad('1', cast(length({d}) div 2 as int) + 1, '0') as bigint)", f"9 * cast(rpad('1', cast({rest} as int) + 1, '0') as bigint)"
    new = f"concat(lpad(cast(r.x as string), cast(length({d}) div 2 as int), '0'), lpad(cast(r.y div 9 as string), cast({rest} as int), '0'))"
    end = let(new, "p", f"concat(p, cast(({check_digit('p')} + r.y % 9 + 1) % 10 as string))")
    return let(feistel(hi, lo, a, b, key, f"concat('other', length({d}))"), "r", end)


def number(d: str, key: str) -> str:
    """Digits permuted among those of their length that pass Luhn's test as they do, where 13 to 19 digits make it count."""
    body = f"substring({d}, 1, length({d}) - 1)"
    card = let(digits(body, key, "'card'"), "p", f"concat(p, cast({check_digit('p')} as string))")
    pieces = f"array_join(transform(sequence(0, (length({d}) - 1) div 18), j -> {let(f'substring({d}, cast(j * 18 + 1 as int), 18)', 'w', digits('w', key))}), '')"
    return f"case when length({d}) between 13 and 19 then if({luhn_sum(d)} % 10 = 0, {card}, {no_card(d, key)}) when length({d}) <= 36 then {digits(d, key)} else {pieces} end"


def put_back(m: str, d: str) -> str:
    """The digits d at the digit places of m, a short match with separators."""
    return f"array_join(transform(sequence(1, length({m})), i -> if(substring({m}, i, 1) between '0' and '9', substring({d}, length(regexp_replace(substring({m}, 1, i), '[^0-9]', '')), 1), substring({m}, i, 1))), '')"


def only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of one match m."""
    digest = lambda tag, v, n: f"substring(sha2(concat_ws('|', {_lit(key)}, {_lit(tag)}, lower({v})), 256), 1, {n})"
    at = f"substring_index({m}, '@', 1)"
    domain = f"substring_index({m}, '@', -1)"
    email = f"concat('u', {digest('user', at, 12)}, '@d', {digest('domain', domain, 12)}, '.', substring_index({domain}, '.', -1))"
    part = lambda k: f"cast(split({m}, '[.]')[{k}] as bigint)"
    ip_value = feistel(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", key, "'ip'")
    ip = let(ip_value, "r", "concat_ws('.', r.x div 256, r.x % 256, r.y div 256, r.y % 256)")
    ip_ok = f"forall(split({m}, '[.]'), x -> cast(x as int) <= 255)"
    long_digest = f"substring(array_join(transform(sequence(0, length({m}) div 64), j -> sha2(concat_ws('|', {_lit(key)}, 'secret', j, lower({m})), 256)), ''), 1, length({m}))"
    secret = f"if({m} = upper({m}), upper({long_digest}), {long_digest})"

    def date(form: str) -> str:
        day = f"datediff(cast(try_to_timestamp({m}, '{form}') as date), date'1900-01-01')"
        moved = let(feistel(f"n div {DAYS_B}", f"n % {DAYS_B}", str(DAYS_A), str(DAYS_B), key, "'day'"), "r", f"date_format(date_add(date'1900-01-01', cast(r.x * {DAYS_B} + r.y as int)), '{form}')")
        return let(day, "n", f"if(n is null or n < 0 or n >= {DAYS_A * DAYS_B}, {m}, {moved})")

    area, group, serial = (f"cast(split({m}, '-')[{k}] as bigint)" for k in range(3))
    ssn_ok = f"({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0)"
    ssn_value = feistel(f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", str(898 * 99), "9999", key, "'ssn'")
    ssn = let(ssn_value, "r", "concat(lpad(cast(r.x div 99 + if(r.x div 99 >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(r.x % 99 + 1 as string), 2, '0'), '-', lpad(cast(r.y + 1 as string), 4, '0'))")
    after_plus = f"regexp_extract({m}, '^([+][0-9]{{1,3}}(?=[ .(-]))?(.*)$', 2)"
    country = f"regexp_extract({m}, '^([+][0-9]{{1,3}}(?=[ .(-]))?(.*)$', 1)"
    phone = f"concat({country}, {let(after_plus, 'q', put_back('q', '(' + digits(only_digits('q'), key, _lit('tel')) + ')'))})"
    card = let(only_digits(m), "d", let(number("d", key), "e", put_back(m, "e")))
    return f"""case
        when contains({m}, '@') then {email}
        when {m} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then if({ip_ok}, {ip}, {m})
        when {m} rlike '[A-Fa-f]' then {secret}
        when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then {date('yyyy-MM-dd')}
        when {m} rlike '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' then {date('dd.MM.yyyy')}
        when {m} rlike '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$' then {date('dd/MM/yyyy')}
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({ssn_ok}, {ssn}, {m})
        when {m} rlike '^[0-9]+$' then {number(m, key)}
        when {m} rlike '^[0-9]{{4}}[ -][0-9]{{4}}[ -]' then {card}
        else {phone} end"""


_DRAWN: list[str] = []


def session_key(spark) -> str:
    """The session's ``spark.tessel.pii.secret``, else a key drawn once for this process."""
    if not _DRAWN:
        _DRAWN.append(secrets.token_hex(16))
    return spark.conf.get("spark.tessel.pii.secret", None) or _DRAWN[0]


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with every private value in ``column`` replaced, and ``n_private`` (int), how many were replaced."""
    key = key or session_key(docs.sparkSession)
    gaps = F.split(column, PRIVATE, -1)
    found = F.regexp_extract_all(column, F.lit(PRIVATE), F.lit(0))
    d = docs.drop("n_private").withColumn("_pi_found", F.when(F.col(column).rlike("[0-9@]|[0-9A-Fa-f]{32}"), found))
    d = d.withColumn("_pi_new", F.expr(f"transform(_pi_found, m -> {pseudonym('m', key)})"))
    d = d.withColumn("n_private", F.coalesce(F.size(F.filter(F.arrays_zip("_pi_found", "_pi_new"), lambda z: z["_pi_found"] != z["_pi_new"])), F.lit(0)))
    joined = F.array_join(F.zip_with(gaps, F.concat(F.col("_pi_new"), F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")
    d = d.withColumn(column, F.when(F.size("_pi_found") > 0, joined).otherwise(F.col(column)))
    return d.withColumn("n_private", F.when(F.col("n_private") > 0, F.col("n_private")).otherwise(0)).drop("_pi_found", "_pi_new")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "text", "n_private")
