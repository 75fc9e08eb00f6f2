"""Text functions as SQL expressions: each takes the SQL text of its arguments and gives SQL text that both engines plan.

``SPARK`` writes them for ``F.expr`` or ``spark.sql``, ``DUCK`` for the check against DuckDB. Names that a caller knows
(aliases, rules, categories) are parameters. Patterns avoid backslashes, lookarounds and escapes, which the engines read differently.
"""

from __future__ import annotations


class Dialect:
    """The functions that the two engines call differently."""

    def __init__(self, duck: bool = False):
        self.duck = duck

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}'" + (", 'g')" if self.duck else ")")

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')" if self.duck else f"regexp_like({x}, '{pattern}')"

    def parts(self, x: str, by: str) -> str:
        return f"string_split({x}, '{by}')" if self.duck else f"split({x}, '[{by}]', -1)"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)" if self.duck else f"CAST(size({x}) AS BIGINT)"

    def sha256(self, x: str) -> str:
        return f"sha256({x})" if self.duck else f"sha2({x}, 256)"

    def words(self, x: str) -> str:
        """Distinct words of a text of single spaces, sorted."""
        return f"list_sort(list_distinct(string_split({x}, ' ')))" if self.duck else f"array_sort(array_distinct(split({x}, ' ')))"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))" if self.duck else f"size(array_intersect({a}, {b}))"

    def one_edit(self, a: str, b: str) -> str:
        """At most one insertion, deletion, substitution or swap of neighbours apart."""
        if self.duck:
            return f"damerau_levenshtein({a}, {b}) <= 1"
        swapped = f"concat(substr({b}, 1, i - 1), substr({b}, i + 1, 1), substr({b}, i, 1), substr({b}, i + 2))"
        return f"(levenshtein({a}, {b}) <= 1 OR length({a}) = length({b}) AND levenshtein({a}, {b}) = 2 AND exists(sequence(1, greatest(length({a}) - 1, 1)), i -> {a} = {swapped}))"


SPARK, DUCK = Dialect(), Dialect(True)


def extract(x: str, pattern: str, group: int = 1) -> str:
    """A group, or null where the pattern does not match."""
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def tokens(x: str, d: Dialect = SPARK) -> str:
    """Lower-case words and numbers, one space between them."""
    return f"trim({d.sub(f'lower({x})', '[^a-z0-9]+', ' ')})"


def ladder(rules: list[tuple[str, str]], default: str = "NULL") -> str:
    """The value of the first rule that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {default} END"


def brand_folder(x: str, aliases: dict[str, str], noise: str = "^(misc|unknown|others?)$", d: Dialect = SPARK) -> str:
    """Noise is null; aliases first; then a leading Z_ and a doubled leading A go and marks become spaces."""
    plain = d.sub(f"trim({x})", "^[Zz]_", "")
    rules = [(d.has(f"lower(trim({x}))", noise), "NULL")] + [(f"lower({plain}) = '{k}'", f"'{v}'") for k, v in aliases.items()]
    return ladder(rules, f"trim({d.sub(d.sub(plain, '^A([A-Z])', DUCK_GROUP if d.duck else SPARK_GROUP), '[_#]+', ' ')})")


SPARK_GROUP, DUCK_GROUP = "$1", "\\1"


def canonical_brand(x: str, d: Dialect = SPARK) -> str:
    """The key by which spellings are equal: letters and digits only."""
    return d.sub(f"lower({x})", "[^a-z0-9]+", "")


def stripped_suffix(x: str, d: Dialect = SPARK) -> str:
    """Without trailing marks of promotion, price or artwork."""
    return f"trim({d.sub(x, '([ _-]+(promo|offer|free|new|old|rs[ ]?[0-9]+|art[0-9]+))+$', '')})"


def crop_name(x: str) -> dict[str, str]:
    """Session, index and box of <session>_crop<index>_<x1>_<y1>_<x2>_<y2>.<ext>; a name that does not match is hashed."""
    p = "^([A-Za-z0-9-]+)_crop([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)[.][a-z]+$"
    out = {"session": f"coalesce({extract(x, p, 1)}, substr(sha1({x}), 1, 12))", "crop": f"CAST({extract(x, p, 2)} AS BIGINT)"}
    return out | {n: f"CAST({extract(x, p, i)} AS BIGINT)" for i, n in enumerate(("x1", "y1", "x2", "y2"), 3)}


def shelf_name(x: str) -> dict[str, str]:
    """Outlet, asset, day and milliseconds of <outlet>_<asset>_<yyyymmdd>_<ms>.<ext>."""
    p = "^([0-9]+)_([a-z]+)_([0-9]{4})([0-9]{2})([0-9]{2})_([0-9]{10,13})[.][a-z]+$"
    day = f"CASE WHEN {extract(x, p, 3)} IS NOT NULL THEN concat({extract(x, p, 3)}, '-', {extract(x, p, 4)}, '-', {extract(x, p, 5)}) END"
    return {"outlet": extract(x, p, 1), "asset": extract(x, p, 2), "day": f"CAST({day} AS DATE)", "ms": f"CAST({extract(x, p, 6)} AS BIGINT)"}


def outlet_code(x: str) -> str:
    """The first run of 6 to 12 digits between other marks, else a hash."""
    return f"coalesce({extract(x, '(?:^|[^0-9])([0-9]{6,12})(?:[^0-9]|$)')}, substr(sha1({x}), 1, 10))"


def near_spelling(a: str, b: str, least: int = 5, d: Dialect = SPARK) -> str:
    """Equal, or of ``least`` letters and one edit or one swap of neighbours apart, at any length."""
    return f"({a} = {b} OR least(length({a}), length({b})) >= {least} AND {d.one_edit(a, b)})"


def packaging(x: str, d: Dialect = SPARK) -> str:
    """The kind of pack a text names, first rule wins."""
    kinds = ["sachet", "pouch", "bottle", "jar", "box", "tube"]
    return ladder([(d.has(f"lower({x})", f"(^|[^a-z]){k}s?([^a-z]|$)"), f"'{k}'") for k in kinds], "'other'")


def size_token(x: str, d: Dialect = SPARK) -> str:
    """Number and folded unit; kilograms and litres up to 10 count a thousandfold."""
    n, unit = extract(f"lower({x})", "([0-9]+([.][0-9]+)?) ?(kg|gms?|g|ml|ltr|l)([^a-z]|$)", 1), extract(f"lower({x})", "([0-9]+([.][0-9]+)?) ?(kg|gms?|g|ml|ltr|l)([^a-z]|$)", 3)
    number = f"CAST({n} AS DOUBLE)"
    folded = f"CASE WHEN {unit} IN ('kg', 'g', 'gm', 'gms') THEN 'g' ELSE 'ml' END"
    return f"CASE WHEN {n} IS NOT NULL THEN concat(CAST(CAST(CASE WHEN {unit} IN ('kg', 'l', 'ltr') AND {number} <= 10 THEN {number} * 1000 ELSE {number} END AS BIGINT) AS VARCHAR(20)), {folded}) END"


def fenced(x: str, d: Dialect = SPARK) -> str:
    """A text that is not trusted, its own marks taken out, between marks."""
    return f"concat('<shelf_text>', {d.sub(x, '</?shelf_text>', '')}, '</shelf_text>')"


def class_label(x: str) -> dict[str, str]:
    """brand|variant|size|pack|category; any other number of parts is invalid."""
    names = ["brand", "variant", "size", "pack", "category"]
    valid = f"length({x}) - length(replace({x}, '|', '')) = 4"
    return {"valid": valid} | {n: f"CASE WHEN {valid} THEN nullif(split_part({x}, '|', {i}), '') END" for i, n in enumerate(names, 1)}
