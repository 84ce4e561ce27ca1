"""Column functions on text: normalisation, hashing, identifiers, URLs, amounts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_whitespace(c: Column) -> Column:
    """Unicode white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tidy_text(c: Column) -> Column:
    """Line feeds only, blanks collapsed within lines, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def content_hash(body: Column, subject: Column) -> Column:
    return F.sha2(F.concat_ws("\n", normalize_whitespace(body), normalize_whitespace(subject)), 256)


def message_id(c: Column) -> Column:
    """Without its angle brackets, one on each side; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), r"^<|>$", "")), F.lit(""))


def compact(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z]", "")


def name_tokens(c: Column, stop: tuple[str, ...], least: int = 4) -> Column:
    parts = F.split(F.lower(c), "[^0-9a-z]+")
    return F.array_except(F.filter(parts, lambda w: F.length(w) >= least), F.array(*map(F.lit, stop)))


def normalize_iban(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban_valid(c: Column) -> Column:
    """Length by country and remainder 1 modulo 97, folded digit by digit; null counts as invalid."""
    c = normalize_iban(c)
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    moved = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    digits = F.transform(F.filter(F.split(moved, ""), lambda d: d != ""), lambda d: F.conv(d, 36, 10).cast("int"))
    rest = F.aggregate(digits, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    known = F.coalesce(F.element_at(lengths, F.substring(c, 1, 2)) == F.length(c), F.lit(False))
    return F.coalesce(known & c.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$") & (rest == 1), F.lit(False))


def demo_iban(number: Column, country: str = "DE") -> Column:
    """A valid IBAN around an account number of 18 digits."""
    account = F.lpad(number.cast("string"), 18, "0")
    code = "".join(str(ord(x) - 55) for x in country)
    check = 98 - (F.concat(account, F.lit(code + "00")).cast("decimal(38,0)") % 97).cast("int")
    return F.concat(F.lit(country), F.lpad(check.cast("string"), 2, "0"), account)


def mask_iban(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit(" •••• "), F.right(c, F.lit(4)))


def format_euro(c: Column) -> Column:
    """1.234,56 €"""
    return F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(" €"))


def parse_amount(c: Column) -> Column:
    """German notation to a decimal; null where it can't be read."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(14,2)")


def citation_url(c: Column) -> Column:
    """Host without www. in small letters and the path without final slash; null for what isn't http. White space around an
    address doesn't count."""
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(c, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(c.rlike(r"(?i)^https?://[^/?#]"), F.concat(host, path))


def compared_url(c: Column) -> Column:
    """Scheme and host in small letters, the query read and written again without utm_ parameters (in any case), no fragment,
    no final slash, no white space around it. A parameter without value gets an empty one."""
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    web = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    head = F.lower(F.regexp_extract(c, f"({web}[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(c, f"^(?:{web[1:]}[^/?#]*)?([^?#]*)", 1), "/+$", "")
    # a percent sign that begins no escape stands for itself
    read = lambda x: F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    written = lambda x: F.replace(F.replace(F.url_encode(read(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    parts = F.filter(F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(read(p["k"])).startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(written(p["k"]), F.lit("="), written(p["v"]))), "&")
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_front_page(c: Column) -> Column:
    """No path, and no query but for utm_ parameters."""
    c = F.trim(c)
    query = F.filter(F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    return F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).isin("", "/") & (F.size(query) == 0)


#: The newsletters' own sites.
NEWSLETTER_HOSTS = ("tldr.tech", "tldrnewsletter.com", "alphasignal.ai")


def _host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_own_site(c: Column, hosts: tuple[str, ...] = NEWSLETTER_HOSTS) -> Column:
    """On one of the hosts or below it."""
    host = _host(c)
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


def is_article_link(c: Column, hosts: tuple[str, ...] = NEWSLETTER_HOSTS) -> Column:
    """A web address, but for the front pages of the newsletters' own sites; null isn't one."""
    web = F.trim(c).rlike(r"(?i)^https?://[^/?#]")
    return F.coalesce(web & ~(is_front_page(c) & is_own_site(c, hosts)), F.lit(False))


def url_in_text(c: Column, body: Column, hosts: tuple[str, ...] = NEWSLETTER_HOSTS) -> Column:
    """An article link that the text has: as it stands, without scheme and query, or, on GitHub, as owner/repo."""
    c = F.trim(c)
    path = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(F.concat(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]*)", 1), path), "/+$", "")
    repo = F.regexp_replace(path, "^/+|/+$", "")
    github = _host(c).isin("github.com", "www.github.com") & repo.rlike("^[^/]+/[^/]+$") & F.contains(body, repo)
    return F.coalesce(is_article_link(c, hosts) & (F.contains(body, c) | F.contains(body, bare) | github), F.lit(False))


def title_key(c: Column) -> Column:
    """Letters only, small, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}]", " "), " +", " "))


def clean_cell(c: Column) -> Column:
    """No-break blanks and dashes made plain, "$ 1" to "$1", "( 12 )" to "(12)"."""
    c = F.translate(c, " –—−", " ---")
    c = normalize_whitespace(c)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\$ +", r"\$"), r"\( +", "("), r" +\)", ")")


def is_amount(c: Column) -> Column:
    return c.rlike(r"^\(?\$?[\d,]+(?:\.\d+)?\)?$")


def section_of(headings: Column, text: Column) -> Column:
    """Headings joined by " > ", else the first "Item ..." of the text."""
    return F.coalesce(F.nullif(F.array_join(headings, " > "), F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)\b(item\s+\d+[a-z]?\b\.?)", 1), F.lit("")))


def excerpt(c: Column, most: int = 800) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def limited(c: Column, most: int = 12_000) -> Column:
    """A text of at most `most` characters, the last three of a longer one dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def chat_title(c: Column, most: int = 80) -> Column:
    c = normalize_whitespace(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def strip_citation_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\[\d+(?:,\s*\d+)*\]", "")


def coverage_line(sources: Column, items: Column, first: Column, last: Column) -> Column:
    """both newsletters · 3 items · Oct 12–14"""
    who = F.when(F.size(sources) > 1, "both newsletters").otherwise(F.element_at(sources, 1))
    same_month = F.date_format(first, "yyyy-MM") == F.date_format(last, "yyyy-MM")
    days = F.when(first == last, F.date_format(first, "MMM d")).when(same_month, F.concat(F.date_format(first, "MMM d"), F.lit("–"), F.date_format(last, "d"))).otherwise(F.concat(F.date_format(first, "MMM d"), F.lit("–"), F.date_format(last, "MMM d")))
    return F.concat_ws(" · ", who, F.concat(items.cast("string"), F.when(items == 1, " item").otherwise(" items")), days)


def xml_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def epc_payload(payee: Column, iban: Column, bic: Column, amount: Column, reference: Column) -> Column:
    """The lines of a transfer code; null unless the amount is within 0.01 and 999999999.99 and of whole cents. Final empty
    lines go."""
    cents = amount.cast("decimal(38,10)")
    exact = (F.round(cents, 2) == cents) & cents.between(F.lit("0.01").cast("decimal(12,2)"), F.lit("999999999.99").cast("decimal(12,2)"))
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    lines = F.concat_ws("\n", F.lit("BCD"), F.lit("002"), F.lit("1"), F.lit("SCT"), F.upper(trimmed(bic)), F.substring(trimmed(payee), 1, 70), normalize_iban(iban), F.concat(F.lit("EUR"), F.round(cents, 2).cast("decimal(14,2)").cast("string")), F.lit(""), F.lit(""), F.substring(trimmed(reference), 1, 140))
    return F.when(exact, F.regexp_replace(lines, r"\n+$", ""))


def local_date(c: Column, zone: str = "Europe/Berlin") -> Column:
    """The date, in the zone, of a time that is in UTC."""
    return F.to_date(F.from_utc_timestamp(c.cast("timestamp"), zone))


#: What an invoice is called in file names.
INVOICE_WORDS = ("rechnung", "invoice", "faktura", "factura", "facture", "számla", "szamla")


def invoice_filename(c: Column, names: tuple[str, ...] = INVOICE_WORDS) -> Column:
    return F.lower(c).endswith(".pdf") & F.lower(c).rlike("|".join(names))


def format_plain_amount(amount: Column, currency: Column) -> Column:
    """€12.00, 12.00 USD, or "amount unknown"."""
    shown = amount.cast("decimal(38,2)").cast("string")
    return F.when(amount.isNull(), "amount unknown").when(currency == "EUR", F.concat(F.lit("€"), shown)).otherwise(F.rtrim(F.concat_ws(" ", shown, currency)))


def known_or(c: Column, values: tuple[str, ...], default: str = "other") -> Column:
    c = F.lower(F.trim(c))
    return F.when(c.isin(*values), c).otherwise(default)


def first_known(answers: list[Column], values: tuple[str, ...], default: str = "other") -> Column:
    """The first of several answers that is a known value, trimmed and in small letters; else the default."""
    plain = [F.lower(F.trim(a)) for a in answers]
    return F.coalesce(*[F.when(a.isin(*values), a) for a in plain], F.lit(default))


def contains_fact(body: Column, fact: Column) -> Column:
    return F.contains(F.lower(normalize_whitespace(body)), F.lower(normalize_whitespace(fact)))
