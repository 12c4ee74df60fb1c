"""Field normalisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms of given names and the names they stand for.
NICKNAMES = {
    "BOB": "ROBERT", "BILL": "WILLIAM", "MIKE": "MICHAEL", "RICK": "RICHARD", "TOM": "THOMAS", "JOE": "JOSEPH", "DAN": "DANIEL", "MATT": "MATTHEW",
    "TONY": "ANTHONY", "BEN": "BENJAMIN", "NICK": "NICHOLAS", "ALEX": "ALEXANDER", "GREG": "GREGORY", "TIM": "TIMOTHY", "TED": "THEODORE", "FRED": "FREDERICK",
    "JON": "JONATHAN", "CHARLIE": "CHARLES", "CHRIS": "CHRISTOPHER", "KATE": "KATHERINE", "LIZ": "ELIZABETH", "PEGGY": "MARGARET", "JEN": "JENNIFER",
    "PAT": "PATRICIA", "DEBBIE": "DEBORAH", "BARB": "BARBARA", "SUE": "SUSAN", "BECKY": "REBECCA", "KIM": "KIMBERLY", "STEPH": "STEPHANIE", "VICKY": "VICTORIA",
    "JESS": "JESSICA", "CINDY": "CYNTHIA", "SAM": "SAMANTHA", "RONNIE": "VERONICA", "CILLA": "PRISCILLA",
}
# Postal street words, each with the other ways to write it.
STREET_FORMS = {
    "STREET": "ST STR", "AVENUE": "AVE AV", "ROAD": "RD", "BOULEVARD": "BLVD BOUL", "DRIVE": "DR DRV", "LANE": "LN", "PARKWAY": "PKWY PKY", "COURT": "CT CRT",
    "PLACE": "PL", "TERRACE": "TER", "CIRCLE": "CIR", "HIGHWAY": "HWY", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
STREET_WORDS = {short: word for word, forms in STREET_FORMS.items() for short in forms.split()}


def _folded(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), c)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def clean_npi(c: Column) -> Column:
    """Exactly ten digits, else null."""
    return F.when(F.length(digits(c)) == 10, digits(c))


def clean_phone(c: Column) -> Column:
    """Ten digits, after the leading 1 of eleven is dropped."""
    d = digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def clean_zip(c: Column) -> Column:
    return F.when(F.length(digits(c)) >= 5, F.substring(digits(c), 1, 5))


def clean_state(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.rlike("^[A-Z]{2}$"), s)


def persons(c: Column) -> Column:
    """The persons in a name field, joined by a lower-case 'and'; none in null."""
    return F.coalesce(F.filter(F.transform(F.split(c, r"\s+and\s+"), F.trim), lambda x: x != ""), F.array().cast("array<string>"))


def first_person(c: Column) -> Column:
    """The one whom the row is about."""
    return F.try_element_at(persons(c), F.lit(1))


_CREDENTIAL = r"(?i)[,\s]+(M\.?D|D\.?O|N\.?P|P\.?A|Ph\.?D)\.?\s*$"


def credential(c: Column) -> Column:
    """The credential that ends the first person's name, without points."""
    found = F.regexp_extract(first_person(c), _CREDENTIAL, 1)
    return F.when(found != "", F.upper(F.replace(found, F.lit("."), F.lit(""))))


def bare_name(c: Column) -> Column:
    """Without a final credential and a leading honorific."""
    c = F.regexp_replace(c, _CREDENTIAL, "")
    return F.trim(F.regexp_replace(c, r"(?i)^(Dr|Doctor|Prof)\.?\s+", ""))


def given_name(source: Column, raw: Column) -> Column:
    """Upper-case given name: all that follows the first comma in the payer's feed,
    the first of at least two words elsewhere."""
    n = bare_name(first_person(raw))
    words = F.split(n, r"\s+")
    after = F.trim(F.regexp_replace(n, r"^[^,]*,", ""))
    payer = F.when(n.contains(",") & (after != ""), F.upper(after))
    return F.when(source == "payer_feed", payer).otherwise(F.when(F.size(words) >= 2, F.upper(words[0])))


def family_name(source: Column, raw: Column) -> Column:
    n = bare_name(first_person(raw))
    words = F.split(n, r"\s+")
    before = F.trim(F.regexp_replace(n, r",.*$", ""))
    payer = F.when(n.contains(",") & (before != ""), F.upper(before))
    return F.when(source == "payer_feed", payer).otherwise(F.when(F.size(words) >= 2, F.upper(F.element_at(words, -1))))


def canonical_given(c: Column) -> Column:
    return _folded(c, NICKNAMES)


_SUITE = r"\s*(?:\b(?:SUITE|STE|APT|UNIT)|#)\s*\.?\s*([A-Z0-9-]+)\s*$"


def street_tokens(c: Column) -> Column:
    """Words of the street without its suite, street words folded."""
    s = F.regexp_replace(F.regexp_replace(F.upper(c), _SUITE, ""), "[^A-Z0-9 ]", " ")
    return F.transform(F.filter(F.split(s, r"\s+"), lambda t: t != ""), lambda t: _folded(t, STREET_WORDS))


def clean_suite(suite: Column, street: Column) -> Column:
    """The suite column in canonical form, else the suite folded into the street."""
    own = F.trim(F.regexp_replace(F.regexp_replace(F.upper(suite), "[^A-Z0-9 ]", " "), r"\s+", " "))
    own = F.regexp_replace(own, r"\b(STE|APT|UNIT)\b", "SUITE")
    found = F.regexp_extract(F.upper(street), _SUITE, 1)
    return F.coalesce(F.when(own != "", own), F.when(found != "", F.concat(F.lit("SUITE "), found)))


def soundex(c: Column) -> Column:
    """Four-character code in which every non-coded letter, H and W too, parts runs
    of equal digits; null for names without letters."""
    s = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    coded = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    for d in "0123456":
        coded = F.regexp_replace(coded, f"{d}+", d)
    tail = F.replace(F.substring(coded, 2, 200), F.lit("0"), F.lit(""))
    return F.when(s != "", F.substring(F.concat(F.substring(s, 1, 1), tail, F.lit("000")), 1, 4))
