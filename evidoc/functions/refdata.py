"""Lookup values of the operators. Larger tables (labels of more languages, country names) are
parameters of the operators that use them; the values here are defaults."""

from __future__ import annotations

# Digits that a letter may be misread as, and letters for digits.
DIGIT_TO_LETTER = {"0": "O", "1": "I", "2": "Z", "3": "E", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B", "9": "P"}
LETTER_TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "J": "1", "|": "1", "Z": "2", "E": "3", "A": "4", "S": "5", "G": "6", "C": "6", "T": "7", "B": "8", "P": "9"}

# What a character may really be, in the order in which it is tried.
CONFUSIONS = {
    "0": "ODQ", "O": "0DQ", "D": "0O", "Q": "0O", "1": "ILJ|", "I": "1LJ", "L": "1I", "J": "1I", "2": "Z", "Z": "2",
    "3": "E8", "E": "3", "4": "A", "A": "4", "5": "S", "S": "5", "6": "GC", "G": "6", "C": "6G", "7": "T1", "T": "7",
    "8": "B3", "B": "8", "9": "P", "P": "9", "U": "V", "V": "U", "M": "NW", "N": "M", "W": "M", "K": "X", "X": "K",
    "R": "P", "H": "N", "F": "P",
}

# Symbols that stand for a filler or a digit in a machine-readable line.
SYMBOLS_FROM = "«‹›»(){}[] .,:;'\"`~—–-_@#$%!?¡"
SYMBOLS_TO = "<" * 27 + "171"

# First characters that a first line may have.
LINE1_TYPES = "PRBFCDIAVOT"

# Issuing codes that are no ISO 3166 countries (Doc 9303, part 3).
SPECIAL_CODES = {
    "D": "Germany",
    "D<<": "Germany",
    "GBD": "United Kingdom (British Overseas Territories Citizen)",
    "GBN": "United Kingdom (British National Overseas)",
    "GBO": "United Kingdom (British Overseas Citizen)",
    "GBP": "United Kingdom (British Protected Person)",
    "GBS": "United Kingdom (British Subject)",
    "RKS": "Republic of Kosovo",
    "EUE": "European Union",
    "UNO": "United Nations Organization",
    "UNA": "United Nations Specialized Agency",
    "UNK": "United Nations Interim Administration Mission in Kosovo",
    "XXA": "Stateless Person (1954 Convention)",
    "XXB": "Refugee (1951 Convention)",
    "XXC": "Refugee (non-Convention)",
    "XXX": "Unspecified Nationality",
    "XOM": "Sovereign Military Order of Malta",
    "XCC": "Caribbean Community",
    "XCO": "Common Market for Eastern and Southern Africa",
    "XEC": "Economic Community of West African States",
    "XPO": "International Criminal Police Organization (INTERPOL)",
    "XDC": "Southern African Development Community",
    "XAC": "African Union Commission",
    "XBA": "African Development Bank",
    "XIM": "African Export-Import Bank",
    "XBB": "African Reinsurance Corporation",
    "XBC": "African Regional Industrial Property Organization",
    "XBD": "African Union",
    "XAA": "Caribbean Development Bank",
    "YUG": "Yugoslavia (historical)",
    "SCG": "Serbia and Montenegro (historical)",
    "ZAR": "Zaire (historical)",
    "ANT": "Netherlands Antilles (historical)",
    "NTZ": "Neutral Zone (historical)",
    "XXD": "Unspecified Nationality",
}

# Names that differ from the Java platform's English ones.
COUNTRY_NAMES = {"TUR": "Türkiye", "GBR": "United Kingdom", "KOR": "South Korea"}

# Month tokens.
MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    # Turkish
    "OCA": 1, "ŞUB": 2, "SUB": 2, "NIS": 4, "NİS": 4, "HAZ": 6, "TEM": 7, "AĞU": 8, "AGU": 8, "EYL": 9, "EKI": 10, "EKİ": 10, "KAS": 11, "ARA": 12,
    # French
    "FÉV": 2, "FEV": 2, "AVR": 4, "MAI": 5, "JUIN": 6, "JUIL": 7, "JUILLET": 7, "AOÛ": 8, "AOU": 8, "DÉC": 12,
    # German
    "MÄR": 3, "MRZ": 3, "OKT": 10, "DEZ": 12,
    # Spanish, Portuguese
    "ENE": 1, "ABR": 4, "AGO": 8, "SET": 9, "OUT": 10, "DIC": 12,
    # Italian, Dutch
    "GEN": 1, "MAG": 5, "GIU": 6, "LUG": 7, "OTT": 10, "MEI": 5,
    # Finnish
    "TAM": 1, "HEL": 2, "MAA": 3, "HUH": 4, "TOU": 5, "KES": 6, "ELO": 8, "SYY": 9, "LOK": 10, "JOU": 12,
    # Polish
    "STY": 1, "LUT": 2, "KWI": 4, "CZE": 6, "LIP": 7, "SIE": 8, "WRZ": 9, "PAŹ": 10, "PAZ": 10, "LIS": 11, "GRU": 12,
    # Romanian
    "IAN": 1, "IUN": 6, "IUL": 7, "NOI": 11,
    # Czech, Slovak
    "LED": 1, "ÚNO": 2, "DUB": 4, "KVĚ": 5, "KVE": 5, "ČVN": 6, "ČVC": 7, "SRP": 8, "ZÁŘ": 9, "ZAR": 9, "ŘÍJ": 10, "RIJ": 10, "PRO": 12,
    # Indonesian, Malay
    "AGT": 8, "DES": 12,
}

# Sex tokens.
SEX_TOKENS = {"M": "M", "MALE": "M", "ERKEK": "M", "H": "M", "HOMME": "M", "F": "F", "FEMALE": "F", "KADIN": "F", "W": "F", "FEMME": "F", "X": "X"}

# Field labels of English, French, German, Spanish, Italian, Portuguese, Dutch and
# Turkish documents. Labels of further languages are given to the operators as a parameter.
LABELS = {
    "surname": (
        "surname", "family name", "last name", "nom", "nom de famille", "nachname", "familienname", "soyadı", "soyadi", "soyad",
        "apellidos", "apelidos", "cognome", "sobrenome", "achternaam", "geslachtsnaam",
    ),
    "given_names": (
        "given names", "given name", "forenames", "first name", "first names", "prénoms", "prenoms", "prénom", "prenom", "vornamen",
        "vorname", "adı", "adi", "nombres", "nombre", "nome", "nomes", "nome proprio", "voornamen", "voornaam",
    ),
    "passport_number": (
        "passport no", "passport no.", "passport number", "document no", "document number", "doc no", "numéro de passeport",
        "no de passeport", "passeport no", "pasaport no", "pass-nr", "reisepass-nr", "passnummer", "pass nr", "número de pasaporte",
        "numero de pasaporte", "pasaporte no", "número do passaporte", "passaporto n", "numero passaporto", "paspoortnummer",
    ),
    "nationality": (
        "nationality", "nationalité", "nationalite", "staatsangehörigkeit", "staatsangehorigkeit", "uyruğu", "uyrugu", "nacionalidad",
        "nacionalidade", "nazionalità", "nazionalita", "cittadinanza", "nationaliteit",
    ),
    "date_of_birth": (
        "date of birth", "birth date", "born", "d.o.b", "dob", "date de naissance", "geburtsdatum", "doğum tarihi", "dogum tarihi",
        "fecha de nacimiento", "data de nascimento", "data di nascita", "geboortedatum",
    ),
    "sex": ("sex", "gender", "sexe", "geschlecht", "cinsiyeti", "cinsiyet", "sexo", "sesso", "geslacht", "sex/sexe"),
    "place_of_birth": (
        "place of birth", "birthplace", "lieu de naissance", "geburtsort", "doğum yeri", "dogum yeri", "lugar de nacimiento",
        "local de nascimento", "luogo di nascita", "geboorteplaats",
    ),
    "date_of_issue": (
        "date of issue", "issue date", "issued", "issued on", "date de délivrance", "date de delivrance", "date d’émission",
        "ausstellungsdatum", "veriliş tarihi", "verilis tarihi", "düzenleme tarihi", "fecha de expedición", "fecha de expedicion",
        "data de emissão", "data di rilascio", "datum van afgifte",
    ),
    "date_of_expiry": (
        "date of expiry", "expiry date", "expiration date", "date of expiration", "valid until", "expires", "date d’expiration",
        "date de validité", "ablaufdatum", "gültig bis", "gultig bis", "son kullanma tarihi", "geçerlilik tarihi", "gecerlilik tarihi",
        "son geçerlilik tarihi", "fecha de caducidad", "válido hasta", "data de validade", "data di scadenza", "geldig tot",
        "geldigheidsdatum",
    ),
    "issuing_authority": (
        "authority", "issuing authority", "issuing office", "autorité", "autorite", "autorité de délivrance", "behörde", "behorde",
        "ausstellende behörde", "veren makam", "düzenleyen makam", "autoridad", "autoridade", "autorità", "autoriteit",
    ),
}

# Weights of the fields in the overall confidence.
WEIGHTS = {
    "passport_number": 0.25,
    "surname": 0.15,
    "given_names": 0.15,
    "date_of_birth": 0.15,
    "expiry_date": 0.15,
    "nationality": 0.05,
    "sex": 0.05,
    "place_of_birth": 0.025,
    "date_of_issue": 0.025,
}
