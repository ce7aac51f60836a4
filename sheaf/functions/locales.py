"""Fixed tables of regional notations."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Notation:
    decimal: str
    grouping: str
    numeric: tuple[str, ...]
    abbreviated: tuple[str, ...]
    long: tuple[str, ...]


# Separators and date patterns by locale. A grouping space stands for any of the spaces in use.
LOCALES = {
    "en_US": Notation(".", ",", ("M/d/yyyy", "M/d/yy"), ("MMM d, yyyy",), ("MMMM d, yyyy",)),
    "en_GB": Notation(".", ",", ("dd/MM/yyyy", "d/M/yyyy", "d/M/yy"), ("d MMM yyyy",), ("d MMMM yyyy",)),
    "de_DE": Notation(",", ".", ("d.M.yyyy", "d.M.yy"), ("d. MMM yyyy", "dd.MM.yyyy"), ("d. MMMM yyyy",)),
    "fr_FR": Notation(",", " ", ("dd/MM/yyyy", "d/M/yyyy"), ("d MMM yyyy",), ("d MMMM yyyy",)),
    "es_ES": Notation(",", ".", ("d/M/yyyy", "d/M/yy"), ("d MMM yyyy",), ("d 'de' MMMM 'de' yyyy",)),
    "it_IT": Notation(",", ".", ("d/M/yyyy", "d/M/yy"), ("d MMM yyyy",), ("d MMMM yyyy",)),
    "ja_JP": Notation(".", ",", ("yyyy/M/d", "yyyy/MM/dd"), ("yyyy/MM/dd",), ("yyyy年M月d日",)),
}

# Units of measure that may follow a number.
UNITS = ("kilometers", "gallons", "metres", "meters", "liters", "litres", "miles", "gal", "lbs", "km", "mi", "ft", "yd", "kg", "lb", "oz", "m", "l", "g")

# Currency symbols and codes; single letters count only beside a digit at an edge.
SYMBOLS = (
    "$", "€", "£", "¥", "￥", "₹", "₽", "₩", "₪", "₫", "฿", "₴", "₺", "₦", "₱", "₡", "₲", "₵", "₸", "₭", "₮", "₾", "₼", "₨", "؋", "৳", "៛", "﷼", "₿", "¢", "¤",
    "R$", "US$", "A$", "CA$", "C$", "HK$", "NZ$", "MX$", "NT$", "S$", "CN¥", "JP¥", "kr.", "kr", "zł", "Kč", "Ft", "lei", "лв.", "ден", "дин.", "руб.", "грн", "Rp", "RM", "Rs", "Fr.", "Bs", "Gs.", "S/", "د.إ", "ر.س", "ج.م", "CFA", "FCFA", "CFPF", "KM", "TL", "Lt", "Ls",
    "USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "CNY", "INR", "BRL",
)
LETTER_SYMBOLS = ("R", "K", "L", "P", "D", "E", "G", "Q", "T")

# Dates of unknown notation, in the order in which they are tried; a day comes before a month.
DATE_PATTERNS = (
    "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd-MM-yy", "dd.MM.yy", "MM/dd/yyyy", "MM-dd-yyyy", "MM/dd/yy", "MM-dd-yy",
    "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "yyyyMMdd", "ddMMyyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy",
)

# Texts of booleans, lower-cased.
TRUE_TEXTS = ("true", "yes", "1", "y", "t", "on")
FALSE_TEXTS = ("false", "no", "0", "n", "f", "off")
MORE_TRUE_TEXTS = ("full", "fulltank", "oui", "si", "sí", "ja", "да", "是", "満", "voll", "真")
MORE_FALSE_TEXTS = ("partial", "partialtank", "non", "nein", "нет", "否", "部分", "假")


def notation(locale: str) -> Notation:
    name = locale.replace("-", "_")
    if name not in LOCALES:
        raise ValueError(f"unknown locale {locale!r}; known: {', '.join(sorted(LOCALES))}")
    return LOCALES[name]
