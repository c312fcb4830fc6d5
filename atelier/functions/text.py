"""Scalar functions of a catalogue: makers, styles, places, media, years, URLs. Each takes a
dialect and a column expression and gives SQL text; see atelier.functions.dialect.column."""

from __future__ import annotations

from atelier.functions import rules
from atelier.functions.dialect import Dialect

CJK = "[　぀-ヿ㐀-䶿一-鿿豈-﫿]+"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
SPLIT = r"\s*([,;]|\band\b|\bon\b)\s*"


def medium_fallback(d: Dialect, x: str) -> str:
    """Unmatched media: the first part, shortened when long, with a capital."""
    clean = d.squeeze(x)
    token = f"trim({d.first(clean, SPLIT)})"
    short = f"CASE WHEN length({token}) > 28 THEN {d.first(token, ' +')} ELSE {token} END"
    return d.capital(f"CASE WHEN (length({clean}) > 28 OR {d.match(clean, SPLIT)}) AND {short} <> '' THEN {short} ELSE {clean} END")


def medium_bucket(d: Dialect, x: str) -> str:
    """One of the named buckets, or the fallback."""
    raw = f"trim(coalesce({x}, ''))"
    low = f"lower({raw})"
    when = [f"WHEN {raw} IN ('', '—') OR {d.match(low, rules.TECHNIQUE_ONLY)} THEN ''"]
    for pattern, value in rules.MEDIUM:
        hit = d.match(low, pattern)
        if pattern in rules.EXCEPT:
            hit = f"{hit} AND NOT {d.match(low, rules.EXCEPT[pattern])}"
        when.append(f"WHEN {hit} THEN {d.lit(value)}")
    return f"CASE {' '.join(when)} ELSE {medium_fallback(d, raw)} END"


def medium_family(d: Dialect, x: str) -> str:
    return d.table(x, rules.MEDIUM_FAMILY, "''")


def artist_canon(d: Dialect, x: str) -> str:
    """Without letters of other scripts. Variants of one name are joined from a table."""
    return d.squeeze(d.sub(d.sub(f"coalesce({x}, '')", CJK), r"\(\s*\)"))


def artist_display(d: Dialect, x: str) -> str:
    """First line without life dates and parentheses; blank where unknown."""
    s = d.squeeze(d.sub(d.sub(d.first(f"coalesce({x}, '')", "\\n"), r"\([^)]*\)"), r",? *[0-9]{4} ?[-–] ?[0-9]{0,4}"))
    return f"CASE WHEN {d.match(s, '(?i)^(unknown|anonymous|unidentified).*$')} THEN '' ELSE {s} END"


def artist_base(d: Dialect, x: str) -> str:
    return d.squeeze(d.sub(x, r"(?i)^(attributed to|studio of|workshop of|circle of|follower of|after|school of|formerly attributed to)\s+"))


def anonymous(d: Dialect, x: str) -> str:
    return f"(trim(coalesce({x}, '')) = '' OR {d.match(x, '(?i)unknown|anonymous|unidentified')})"


def surname(d: Dialect, x: str) -> str:
    return f"lower({d.last(d.squeeze(d.sub(x, '[^A-Za-zÀ-ÿ ]', ' ')), ' ')})"


def style_canon(d: Dialect, x: str, alias: str, is_style: str) -> str:
    """The style an alias table gives (alias, or NULL), blank where is_style is false (labels
    that are nationalities), with a capital."""
    s = f"coalesce({alias}, trim(coalesce({x}, '')))"
    return f"CASE WHEN NOT {is_style} THEN '' WHEN {d.match(s, '^[a-z]')} THEN {d.capital(s)} ELSE {s} END"


def style_clean(d: Dialect, x: str) -> str:
    """Without dates in parentheses, century and year tails and `to ...` tails; long labels
    keep their first part."""
    s = d.sub(x, r"\s*\([^)]*[0-9][^)]*\)")
    s = d.sub(s, r"(?i),?\s*(late|early|mid-?)?\s*[0-9]{1,2}(st|nd|rd|th)\s+century.*$")
    s = d.sub(d.sub(s, r"(?i)\s+to\s+.*$"), r",?\s*[0-9]{3,4}.*$")
    s = f"trim({s})"
    return f"CASE WHEN length({s}) > 34 THEN {d.first(s, ',')} ELSE {s} END"


def movement_suffix(d: Dialect, x: str) -> str:
    return f"trim({d.sub(d.sub(x, r'(?i)\s+painting$'), r'(?i)\s+art$')})"


def deaccent(d: Dialect, x: str) -> str:
    return f"translate(lower({x}), {d.lit(ACCENTS[0])}, {d.lit(ACCENTS[1])})"


def fold_key(d: Dialect, x: str) -> str:
    return d.sub(deaccent(d, x), "[^a-z0-9]")


def place_parts(d: Dialect, x: str) -> tuple[str, str]:
    """The country of a place, and its `(City)` or `/region` suffix as it stands."""
    raw = f"trim(coalesce({x}, ''))"
    return f"trim({d.ext(raw, '^([^(/]*)', 1)})", d.ext(raw, r"^[^(/]*(.*)$", 1)


def place_canon(d: Dialect, x: str, canon: str) -> str:
    """The country's name as a table of spellings gives it (canon, or NULL), its suffix kept:
    a `(City)` after a space, a `/region` without."""
    _, rest = place_parts(d, x)
    joint = f"CASE WHEN substr({rest}, 1, 1) = '(' THEN ' ' ELSE '' END"
    return f"CASE WHEN {canon} IS NULL THEN trim(coalesce({x}, '')) ELSE trim(concat({canon}, {joint}, {rest})) END"


def polity_key(d: Dialect, x: str) -> str:
    """A polity without its form of government, as tables of polities spell it."""
    return d.sub(f"lower(trim({x}))", r"^(kingdom|duchy|republic|crown|grand duchy) of ")


def continent_place(d: Dialect, x: str) -> str:
    """A place as tables of continents spell it: without suffixes, in small letters."""
    return f"lower(trim({d.first(d.sub(x, r'\s*\(.*$'), '/')}))"


def continent_at(d: Dialect, lat: str, lng: str) -> str:
    # fixed values: degrees that part the continents, in this order
    return (
        f"CASE WHEN {lng} >= -82 AND {lng} <= -34 AND {lat} < 13 AND {lat} >= -56 THEN 'South America'"
        f" WHEN {lng} >= -170 AND {lng} <= -52 AND {lat} >= 13 THEN 'North America' WHEN {lng} >= 110 AND {lat} <= -10 THEN 'Oceania'"
        f" WHEN {lng} > 34.5 AND {lat} < 42 AND {lat} >= 12 THEN 'Asia' WHEN {lat} >= 36 AND {lng} >= -25 AND {lng} <= 60 THEN 'Europe'"
        f" WHEN {lat} >= -35 AND {lat} < 36 AND {lng} >= -20 AND {lng} <= 52 THEN 'Africa' WHEN {lng} > 40 THEN 'Asia' ELSE 'Europe' END"
    )


def entity_id(d: Dialect, x: str) -> str:
    return f"nullif({d.ext(x, 'Q[0-9]+')}, '')"


def title_key(d: Dialect, x: str) -> str:
    return f"trim({d.sub(d.sub(d.sub(x, r'\s*\([^)]*\)\s*$'), r'(?i),?\s*from the series.*$'), r',?\s*[0-9]{4}\s*$')})"


def clip(d: Dialect, x: str, n: int = 120) -> str:
    s = d.squeeze(x)
    return f"CASE WHEN length({s}) > {n} THEN concat(substr({s}, 1, {n - 1}), '…') ELSE {s} END"


def image_key(d: Dialect, x: str) -> str:
    return f"lower({d.sub(d.sub(x, '^http:', 'https:'), r'[?&]width=[0-9]+')})"


def file_path(d: Dialect, x: str) -> str:
    return d.sub(d.sub(x, r"/full/[^/]+/", "/full/800,/"), " ", "_")


def year_midpoint(d: Dialect, a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE CAST(floor(({a} + {b}) / 2.0 + 0.5) AS INT) END"


def year_text(d: Dialect, x: str) -> str:
    """Centuries (with early, mid, late and BCE), decades, ranges and plain years."""
    s = f"lower({x})"
    century = d.int(d.ext(s, r"([0-9]{1,2})(st|nd|rd|th) century", 1))
    part = f"CASE WHEN {d.match(s, 'early')} THEN 15 WHEN {d.match(s, 'late')} THEN 85 ELSE 50 END"
    bce = d.match(s, r"\bb\.?c\.?")
    first, second = d.int(d.ext(s, r"([0-9]{3,4})", 1)), d.int(d.ext(s, r"[0-9]{3,4}[^0-9]+([0-9]{3,4})", 1))
    plain = f"CASE WHEN {second} IS NULL THEN {first} ELSE CAST(floor(({first} + {second}) / 2.0 + 0.5) AS INT) END"
    return (
        f"CASE WHEN {century} IS NOT NULL AND {bce} THEN -(({century} - 1) * 100 + (100 - ({part}))) WHEN {century} IS NOT NULL"
        f" THEN ({century} - 1) * 100 + ({part}) WHEN {bce} THEN -({plain}) ELSE {plain} END"
    )


def year_range(d: Dialect, x: str) -> str:
    """`lo,hi` of a range; a short second year borrows the first one's leading digits."""
    s = d.sub(f"trim({x})", r"(?i)^c(a|irca)?\.? *")
    lo, hi = d.ext(s, r"^(-?[0-9]{1,4})", 1), d.ext(s, r"^-?[0-9]{1,4} *[-–/] *(-?[0-9]{1,4})$", 1)
    full = f"CASE WHEN {hi} = '' THEN {lo} WHEN length({hi}) < length({lo}) AND substr({lo}, 1, 1) <> '-' THEN concat(substr({lo}, 1, length({lo}) - length({hi})), {hi}) ELSE {hi} END"
    good = d.match(s, r"^-?[0-9]{1,4}( *[-–/] *-?[0-9]{1,4})?$")
    return f"CASE WHEN {good} AND {d.int(lo)} <= {d.int(full)} THEN concat({lo}, ',', {full}) END"


def year_iso(d: Dialect, x: str) -> str:
    return d.int(d.ext(x, r"^\+?(-?[0-9]{1,6})-", 1))


def year_label(d: Dialect, y: str) -> str:
    return f"CASE WHEN {y} < 0 THEN concat(-{y}, ' BCE') ELSE concat({y}, ' CE') END"


def century(d: Dialect, y: str) -> str:
    """True century: 1 to 100 are the first; -1 to -100 the minus first."""
    return f"CAST(CASE WHEN {y} > 0 THEN floor(({y} - 1) / 100.0) + 1 ELSE -(floor((-{y} - 1) / 100.0) + 1) END AS INT)"


def centimetres(d: Dialect, x: str) -> str:
    """`a × b` with a unit, in centimetres; NULL where no size is found."""
    size = r"([0-9]+\.?[0-9]*) *[x×] *([0-9]+\.?[0-9]*)"
    unit = f"CASE {d.ext(f'lower({x})', r'(mm|cm|in|m)\b', 1)} WHEN 'mm' THEN 0.1 WHEN 'in' THEN 2.54 WHEN 'm' THEN 100.0 ELSE 1.0 END"
    a, b = (f"round(TRY_CAST(nullif({d.ext(x, size, g)}, '') AS DOUBLE) * CAST({unit} AS DOUBLE), 1)" for g in (1, 2))
    return f"CASE WHEN {a} IS NOT NULL THEN concat({a}, ' × ', {b}, ' cm') END"


def junk_title(d: Dialect, x: str) -> str:
    return d.match(x, r"^[A-Z]{0,3}[0-9]+([./-][0-9A-Za-z]+)+$")


def popularity(d: Dialect, views: str, links: str, picked: str = "false") -> str:
    return f"round(120 * ln({views} + 1) + 8 * ln({links} + 1) + CASE WHEN {picked} THEN 2000 ELSE 0 END, 4)"


SIGNS = "[.,;:!?'\"`’“”]"


def guarded(d: Dialect, score: str, title: str, artist: str) -> str:
    """The score, but 0 where a work without a maker has the title of a kind of object, or a
    high score and a bare title of at most two words: those met the concept, not the work."""
    low = f"trim(lower({d.sub(title, SIGNS)}))"
    generic = f"{low} IN ({', '.join(map(d.lit, rules.GENERIC_TITLES))})"
    bare = f"NOT {d.match(f'trim({title})', r'\s+\S+\s')} AND NOT {d.match(title, r'(?i)[0-9]|—|:|\bof\b|\bthe\b')}"
    return f"CASE WHEN {score} > 0 AND trim({artist}) = '' AND ({generic} OR ({score} > 300 AND {bare})) THEN 0 ELSE {score} END"
