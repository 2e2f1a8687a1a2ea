"""Dictionary tables as data, and map literals over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these.
VAT_PREFIXES = {
    "AT": "austria", "BE": "belgium", "BG": "bulgaria", "HR": "croatia", "CY": "cyprus", "CZ": "czech republic", "DK": "denmark",
    "EE": "estonia", "FI": "finland", "FR": "france", "DE": "germany", "EL": "greece", "GR": "greece", "HU": "hungary", "IE": "ireland",
    "IT": "italy", "LV": "latvia", "LT": "lithuania", "LU": "luxembourg", "MT": "malta", "NL": "netherlands", "PL": "poland",
    "PT": "portugal", "RO": "romania", "SK": "slovakia", "SI": "slovenia", "ES": "spain", "SE": "sweden", "GB": "uk",
    "CH": "switzerland", "NO": "norway", "UA": "ukraine", "RU": "russia", "RS": "serbia", "TR": "turkey", "AU": "australia",
    "NZ": "new zealand", "CA": "canada", "US": "usa",
}
IBAN_COUNTRIES = {
    "AL": "albania", "AD": "andorra", "AT": "austria", "AZ": "azerbaijan", "BH": "bahrain", "BY": "belarus", "BE": "belgium",
    "BA": "bosnia", "BR": "brazil", "BG": "bulgaria", "CR": "costa rica", "HR": "croatia", "CY": "cyprus", "CZ": "czech republic",
    "DK": "denmark", "EE": "estonia", "FI": "finland", "FR": "france", "GE": "georgia", "DE": "germany", "GI": "gibraltar",
    "GR": "greece", "HU": "hungary", "IS": "iceland", "IE": "ireland", "IL": "israel", "IT": "italy", "JO": "jordan",
    "KZ": "kazakhstan", "KW": "kuwait", "LV": "latvia", "LB": "lebanon", "LI": "liechtenstein", "LT": "lithuania",
    "LU": "luxembourg", "MT": "malta", "MC": "monaco", "MD": "moldova", "ME": "montenegro", "NL": "netherlands", "NO": "norway",
    "PK": "pakistan", "PL": "poland", "PT": "portugal", "QA": "qatar", "RO": "romania", "SM": "san marino", "SA": "saudi arabia",
    "RS": "serbia", "SK": "slovakia", "SI": "slovenia", "ES": "spain", "SE": "sweden", "CH": "switzerland", "TN": "tunisia",
    "TR": "turkey", "UA": "ukraine", "AE": "uae", "GB": "uk",
}
BIC_EXTRA = {
    "US": "usa", "CA": "canada", "AU": "australia", "NZ": "new zealand", "JP": "japan", "CN": "china", "HK": "hong kong",
    "SG": "singapore", "KR": "south korea", "IN": "india", "ZA": "south africa", "MX": "mexico",
}
BIC_COUNTRIES = IBAN_COUNTRIES | BIC_EXTRA
BIC_BLACKLIST = [
    "KOOKHUIS", "GASTHUIS", "RAADHUIS", "CLUBHUIS", "POSTHUIS", "LANDHUIS", "PAKHUIS", "TOLHUIS", "PAIEMENT", "DOCUMENT", "MOVEMENT",
    "PAVEMENT", "STATEMENT",
]
CURRENCIES = {
    "GBP": ("uk", 0.90), "PLN": ("poland", 0.95), "CZK": ("czech republic", 0.95), "HUF": ("hungary", 0.95), "RON": ("romania", 0.95),
    "BGN": ("bulgaria", 0.95), "HRK": ("croatia", 0.90), "RSD": ("serbia", 0.95), "UAH": ("ukraine", 0.95), "RUB": ("russia", 0.95),
    "CHF": ("switzerland", 0.85), "SEK": ("sweden", 0.95), "NOK": ("norway", 0.95), "DKK": ("denmark", 0.95), "ISK": ("iceland", 0.95),
    "TRY": ("turkey", 0.95), "JPY": ("japan", 0.95), "CNY": ("china", 0.95), "KRW": ("south korea", 0.95), "INR": ("india", 0.95),
    "BRL": ("brazil", 0.95), "MXN": ("mexico", 0.95), "ZAR": ("south africa", 0.95), "AED": ("uae", 0.95),
    "SAR": ("saudi arabia", 0.95), "ILS": ("israel", 0.95), "NZD": ("new zealand", 0.85), "EUR": (None, 0.30), "USD": ("usa", 0.50),
    "CAD": ("canada", 0.80), "AUD": ("australia", 0.80),
}
VAT_FORMATS = {
    "AT": r"^ATU\d{8}$", "BE": r"^BE[01]\d{9}$", "BG": r"^BG\d{9,10}$", "HR": r"^HR\d{11}$", "CY": r"^CY\d{8}[A-Z]$",
    "CZ": r"^CZ\d{8,10}$", "DK": r"^DK\d{8}$", "EE": r"^EE\d{9}$", "FI": r"^FI\d{8}$", "FR": r"^FR[A-Z0-9]{2}\d{9}$",
    "DE": r"^DE\d{9}$", "EL": r"^EL\d{9}$", "GR": r"^GR\d{9}$", "HU": r"^HU\d{8}$", "IE": r"^IE\d[A-Z0-9+*]\d{5}[A-Z]{1,2}$",
    "IT": r"^IT\d{11}$", "LV": r"^LV\d{11}$", "LT": r"^LT(\d{9}|\d{12})$", "LU": r"^LU\d{8}$", "MT": r"^MT\d{8}$",
    "NL": r"^NL\d{9}B\d{2}$", "PL": r"^PL\d{10}$", "PT": r"^PT\d{9}$", "RO": r"^RO\d{2,10}$", "SK": r"^SK\d{10}$",
    "SI": r"^SI\d{8}$", "ES": r"^ES[A-Z0-9]\d{7}[A-Z0-9]$", "SE": r"^SE\d{12}$", "GB": r"^GB(\d{9}|\d{12}|GD\d{3}|HA\d{3})$",
    "CH": r"^CHE\d{9}(MWST|TVA|IVA)?$", "NO": r"^NO\d{9}MVA$",
}
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BY": 28, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28,
    "CZ": 24, "DK": 18, "DO": 28, "TL": 23, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18,
    "GT": 28, "HU": 28, "IS": 26, "IQ": 23, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "MK": 19, "MT": 31, "MR": 27, "MU": 30, "MC": 27, "MD": 24, "ME": 22, "NL": 18, "NO": 15, "PK": 24,
    "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "LC": 32, "SM": 27, "ST": 25, "SA": 24, "RS": 22, "SC": 31, "SK": 24, "SI": 19,
    "ES": 24, "SE": 24, "CH": 21, "TN": 24, "TR": 26, "UA": 29, "AE": 23, "GB": 22, "VA": 22, "VG": 24,
}
CATEGORY_TYPES = {
    "financial": ["invoice", "proforma_invoice", "credit_note", "debit_note", "receipt", "payment_confirmation", "dunning_letter", "purchase_order"],
    "bank": ["bank_statement", "swift_message", "payment_advice", "bank_confirmation", "bank_guarantee"],
    "utility": ["electricity", "gas", "water", "heating", "waste"],
    "telecom": ["mobile", "landline", "internet", "tv"],
    "tax": ["tax_notice", "tax_return", "tax_certificate", "vat_report"],
    "insurance": ["insurance_policy", "insurance_invoice", "insurance_claim"],
    "legal": ["contract", "agreement", "certificate", "power_of_attorney"],
    "other": ["delivery_note", "report", "letter", "unknown"],
}
DOC_TYPE_CATEGORY = {t: c for c, types in CATEGORY_TYPES.items() for t in types}
COUNTRIES = [
    "germany", "france", "italy", "spain", "uk", "poland", "netherlands", "belgium", "austria", "switzerland", "portugal", "greece",
    "czech republic", "romania", "hungary", "sweden", "denmark", "norway", "finland", "ireland", "usa", "canada", "australia",
    "new zealand", "japan", "south korea", "china", "india", "brazil", "mexico", "argentina", "chile", "colombia", "south africa",
    "uae", "saudi arabia", "israel", "turkey", "russia", "ukraine", "slovakia", "slovenia", "croatia", "serbia", "bulgaria",
    "lithuania", "latvia", "estonia", "luxembourg", "malta", "cyprus",
]
COUNTRY_ALIASES = {
    "united kingdom": "uk", "great britain": "uk", "england": "uk", "scotland": "uk", "wales": "uk", "united states": "usa",
    "united states of america": "usa", "america": "usa", "the netherlands": "netherlands", "holland": "netherlands",
    "czech": "czech republic", "czechia": "czech republic", "republic of ireland": "ireland", "deutschland": "germany",
    "allemagne": "germany", "alemania": "germany", "francia": "france", "frankreich": "france", "espana": "spain", "españa": "spain",
    "spanien": "spain", "italia": "italy", "italien": "italy", "polska": "poland", "polen": "poland", "osterreich": "austria",
    "österreich": "austria", "schweiz": "switzerland", "suisse": "switzerland", "svizzera": "switzerland", "belgien": "belgium",
    "belgique": "belgium", "niederlande": "netherlands", "pays-bas": "netherlands", "portugal": "portugal",
    "griechenland": "greece", "grèce": "greece",
}
DOC_TYPE_ALIASES = {
    "bank": "bank_statement", "telecom": "mobile", "tax": "tax_notice", "other": "unknown", "electric": "electricity",
    "power": "electricity", "energy": "electricity", "utility": "electricity", "phone": "mobile", "telephone": "landline",
    "telecommunications": "mobile", "banking": "bank_statement", "financial": "invoice", "statement": "bank_statement",
    "bill": "invoice", "insurance": "insurance_invoice", "proforma": "proforma_invoice", "credit note": "credit_note",
    "debit note": "debit_note", "dunning": "dunning_letter", "purchase order": "purchase_order", "po": "purchase_order",
    "swift": "swift_message", "guarantee": "bank_guarantee", "policy": "insurance_policy", "claim": "insurance_claim",
    "delivery": "delivery_note", "poa": "power_of_attorney",
}
TRUNCATION_KEYWORDS = [
    "datum", "date", "дата", "data", "rechnung", "invoice", "facture", "fattura", "счёт", "счет", "atu", "vat", "ust", "mwst", "iva",
    "tva", "ндс", "inn", "инн", "total", "summe", "betrag", "amount", "итого", "сумма", "address", "anschrift", "adresse", "адрес",
    "iban", "bic", "swift", "bank", "gmbh", "ag", "ltd", "inc", "llc", "ооо", "оао", "зао",
]
COUNTRY_INDICATORS = {
    "germany": ["deutschland", "germany", "de-", "berlin", "münchen", "hamburg", "gmbh"],
    "france": ["france", "francia", "paris", "lyon", "marseille", "sarl", "sas"],
    "italy": ["italia", "italy", "rome", "roma", "milano", "srl", "spa"],
    "spain": ["españa", "spain", "madrid", "barcelona", "s.l.", "s.a."],
    "uk": ["united kingdom", "england", "london", "manchester", "ltd", "plc"],
    "poland": ["polska", "poland", "warszawa", "krakow", "sp. z o.o."],
    "netherlands": ["nederland", "netherlands", "amsterdam", "rotterdam", "b.v."],
    "belgium": ["belgique", "belgium", "bruxelles", "brussels", "antwerp"],
    "austria": ["österreich", "austria", "wien", "vienna", "graz"],
    "switzerland": ["schweiz", "suisse", "switzerland", "zürich", "genève"],
}
EVIDENCE_PREFIXES = {
    "DE": "germany", "FR": "france", "IT": "italy", "ES": "spain", "GB": "uk", "PL": "poland", "NL": "netherlands", "BE": "belgium",
    "AT": "austria", "CH": "switzerland",
}

# What invented personal data looks like.
SUSPICIOUS_PATTERNS = [
    "john doe", "jane doe", "test", "example", "sample", "1234567890", "0123456789", "123456789", "000000", "1990-01-01", "01.01.1990", "1980-01-01", "01.01.1980",
]


def mapping(table: dict) -> Column:
    """A map literal; values may be strings, numbers or None."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def lookup(table: dict, key: Column) -> Column:
    """The table's value, or null for a key it lacks."""
    return F.try_element_at(mapping({k: v for k, v in table.items() if v is not None}), key)


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))
