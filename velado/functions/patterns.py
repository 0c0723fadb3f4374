"""Patterns of personal data, and patterns built from terms.

Java regular expressions: (?U) gives word boundaries, digits and white space their Unicode meaning, (?iU) also ignores
case, and (?d) lets only a line feed end a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns decide what counts as a hit.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?:\+55\s*)?(?:\(?\d{2}\)?\s*)?(?:9\d{4}|\d{4})[-\s]\d{4}\b"
PHONE_CORE = r"(?U)\d{4}[-\s]\d{4}\b"  # the end of every hit of PHONE
CPF = r"(?U)\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
CPF_BARE = r"(?U)(?iU:\bCPF\b\s*(?:n[º°.]?|:\s*)?)\s*(\b\d{11}\b)"
RG = r"(?U)(?iU:\b(?:RG|Identidade)\b\s*(?:n[º°.]?|:\s*)?)\s*([0-9A-Za-z.-]+\s?[0-9A-Za-z]*)"
# The same, cut into what stays and what goes.
CPF_PARTS = r"(?U)\b\d{3}\.(\d{3})\.(\d{3})-\d{2}\b"
CPF_BARE_PARTS = r"(?U)((?iU:\bCPF\b\s*(?:n[º°.]?|:\s*)?)\s*)\b\d{3}(\d{3})(\d{3})\d{2}\b"
RG_PARTS = r"(?U)((?iU:\b(?:RG|Identidade)\b\s*(?:n[º°.]?|:\s*)?)\s*)([0-9A-Za-z.-]+\s?[0-9A-Za-z]*)"
ISSUE_DATE = r"(?iU)(Data de Expedição:)\s*(\d{2}/\d{2}/\d{4})"
SEVEN_DIGITS = r"(?U)\b\d{5}(\d{2})\b"
CRC = r"(?iU)\b[0-9A-F]{8}\b"
MARKER = r"(?iU)\[\s*(EMAIL|TELEFONE|CPF|RG)_\d+\s*\]"
MONEY_BEFORE = r"(?iUd)R\$\s*$"
ACT_BEFORE = r"(?iUd)(?:Chamada|Edital|Portaria|Processo|Parecer|Acórdão|Lei|Decreto)\s+(?:n[º°.]?\s*)?$"
YEARS = r"(?Ud)^(?:19|20)\d{2}[-\s](?:19|20)\d{2}$"
DATE_NEAR = r"(?U)\d{1,4}[/-]\d{1,2}[/-]\d{2,4}"
PUBLIC_NUMBERS = ("0800", "0300", "(0800", "(0300", "+55 0800", "+55 (0800")
PUBLIC_DIGITS = ("0800", "0300", "550800", "550300")
NAME_CAPS = r"(?U)\b[A-ZÀ-Ÿ]{2,}(?: (?:DE|DA|DO|DOS|DAS|E) )?(?: [A-ZÀ-Ÿ]{2,}){1,4}\b"
NAME_TITLE = r"(?U)\b[A-ZÀ-Ÿ][a-zà-ÿ]+(?: (?:de|da|do|dos|das|e) )?(?: [A-ZÀ-Ÿ][a-zà-ÿ]+){1,4}\b"
ANCHORS = (
    r"(?iUd)assinado\s+eletronicamente\s+por\s+([A-ZÀ-Ÿa-zà-ÿ\s]+?)(?:,|\n|\r|em\s+\d|\s*–|\s*-|\.|$)",
    r"(?iUd)(?:Interessad[oa]|Requerente|Relator(?:a)?|Coordenador(?:a)?|Servidor(?:a)?|Bolsista|Proponente|Membro|Pesquisador(?:a)?|Orientador(?:a)?)\s*:\s*([^\n\r,.;\(\)–-]+)",
    r"(?iUd)([A-ZÀ-Ÿa-zà-ÿ][^\n\r,.;\(\)–-]+?)(?:,\s*portador(?:a)?\s*do\s*CPF|,\s*CPF\s*nº|,\s*matrícula|,\s*SIAPE)",
    r"(?iUd)(?:Prof\.|Profa\.|Professora?|Dr\.|Dra\.|Doutora?|Sr\.|Sra\.|Senhora?)\s+([^\n\r,.;\(\)–-]+)",
    r"(?iUd)À\s+consideração\s+d[eoa]\s+([^\n\r,.;\(\)–-]+)",
)
BETWEEN_LETTERS = r"[\s\u00A0\u200B\u200C\u200D\u00AD._-]*"
BETWEEN_WORDS = r"(?:[\s\u00A0\u200B\r\n\t]+|(?:-\s*[\r\n]+\s*))"
#: What may stand between the letters or words of a term, and terms that have none of it at an end and no other sign than ASCII's.
SQUEEZED = r"(?U)[\s\u00A0\u200B\u200C\u200D\u00AD._-]+"
PLAIN = r"^[0-9A-Za-z](?:[ -~]*[0-9A-Za-z])?$"
_CAPITALS = "".join(map(chr, range(65, 91)))


def folded(x: Column) -> Column:
    """Without the case that (?iU) ignores in ASCII letters; as long as before."""
    return F.translate(x, _CAPITALS + "\u212A\u017F\u0130\u0131", _CAPITALS.lower() + "ksii")


def _literal(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch


def tolerant(term: str | None) -> str | None:
    """A pattern that finds the term despite spaces between its letters, line breaks and hyphenation; None for a blank term."""
    words = (term or "").split()
    if not words:
        return None
    return "(?iU)" + BETWEEN_WORDS.join(BETWEEN_LETTERS.join(_literal(c) for c in w) for w in words)


def tolerant_col(term: Column) -> Column:
    """The same pattern of a term in a column."""
    words = F.filter(F.split(term, r"(?U)\s+"), lambda w: w != "")
    letters = lambda w: F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), c).otherwise(F.concat(F.lit("\\"), c)))
    return F.concat(F.lit("(?iU)"), F.array_join(F.transform(words, lambda w: F.array_join(letters(w), BETWEEN_LETTERS)), BETWEEN_WORDS))


def quoted(replacement: Column) -> Column:
    """A replacement that stands for itself."""
    return F.regexp_replace(replacement, r"([\\$])", r"\\$1")
