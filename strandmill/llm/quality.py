"""Line-first quality rules.

Every line is judged alone and lines that fail are taken out; then the document is judged by how much text it lost:

    symbols      a quarter or more of its words carry a run of two or more marks ("word%%%", "WORD!!")
    fragment     fewer than 4 words and no closing mark at its end
    navigation   three or more separators (| » • · ›) with at most 3 words between two of them on average,
                 or a known menu phrase in a line of at most 12 words
    boilerplate  a stock phrase (rights, cookies, scripts, licences) in a line of at most 40 words
    shouting     five or more words with cased letters, of which 70 % are all upper case
    echo         five or more words, of which one word makes half

A document is kept if it passes the base limits and loses at most `max_lost` of its word characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
CLOSING = tuple(".!?…:;\"'”’»)]}。！？")
SEPARATORS = re.compile("[|»•·›]")
MARKS = re.compile(r"[^\w\s]{2,}")
#: Fixed phrases of menus and of stock text in English, German, French and Spanish, lower case.
MENU_PHRASES = {
    "en": "home, sign in, log in, login, next page, previous page, read more, share this, skip to content, back to top, site map",
    "de": "startseite, anmelden, einloggen, nächste seite, vorherige seite, weiterlesen, mehr lesen, zum inhalt springen, nach oben, seitenübersicht",
    "fr": "accueil, se connecter, connexion, page suivante, page précédente, lire la suite, partager, aller au contenu, haut de page, plan du site",
    "es": "inicio, iniciar sesión, acceder, página siguiente, página anterior, leer más, compartir, ir al contenido, volver arriba, mapa del sitio",
}
STOCK_PHRASES = {
    "en": "all rights reserved, cookie policy, uses cookies, privacy policy, terms of use, terms of service, enable javascript, javascript is disabled, lorem ipsum, subscribe to our newsletter, work is licensed under, copyright ©, ©",
    "de": "alle rechte vorbehalten, cookie-richtlinie, verwendet cookies, datenschutzerklärung, nutzungsbedingungen, javascript aktivieren, javascript ist deaktiviert, newsletter abonnieren",
    "fr": "tous droits réservés, politique de cookies, utilise des cookies, politique de confidentialité, conditions d'utilisation, activer javascript, activez javascript, abonnez-vous à notre newsletter",
    "es": "todos los derechos reservados, política de cookies, utiliza cookies, política de privacidad, condiciones de uso, active javascript, activar javascript, suscríbase a nuestro boletín",
}


def any_of(phrases: dict[str, str]) -> str:
    return "|".join(re.escape(p) for line in phrases.values() for p in line.split(", "))


MENU = re.compile(rf"\b({any_of(MENU_PHRASES)})\b")
STOCK = re.compile(rf"{any_of(STOCK_PHRASES)}|^\W*licensed under")


def line_fails(line: str) -> str | None:
    """The name of the first rule that a line with a word fails, else None."""
    words = line.encode().split()
    n = len(words)
    if SEPARATORS.search(line):
        cuts = len(SEPARATORS.findall(line))
        if cuts >= 3 and n - cuts <= 3 * (cuts + 1):
            return "navigation"
    if 4 * len(MARKS.findall(line)) >= n and n >= 4 and 4 * sum(bool(MARKS.search(w.decode())) for w in words) >= n:
        return "symbols"
    if n < 4 and not line.rstrip().endswith(CLOSING):
        return "fragment"
    if n <= 40:
        low = line.lower()
        if n <= 12 and not line.rstrip().endswith(CLOSING) and MENU.search(low):
            return "navigation"
        if STOCK.search(low):
            return "boilerplate"
    if n >= 5:
        if not line.islower() and 10 * sum(w.isupper() for w in line.split()) >= 7 * n:
            return "shouting"
        if 2 * Counter(words).most_common(1)[0][1] >= n:
            return "echo"
    return None


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    code = ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    for k in range(1, width):
        code = code[:-1] * np.int64(len(words)) + ids[k:]
        if len(words) > 2**20:
            code = np.unique(code, return_inverse=True)[1]
    if len(words) <= 2**20:
        order = np.argsort(code)
        same = code[order[1:]] == code[order[:-1]]
        twice = np.zeros(n, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    else:
        twice = (np.bincount(code) > 1)[code]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def judge(text: str | None, max_lost: float = 0.4) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed, chars_removed, cleaned."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen, keep, removed, lost, dup = set(), [], 0, 0, 0
    for line in text.split("\n"):
        if not line.strip(SPACES):
            keep.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line):
            removed += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            keep.append(line)
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    kept = not failed and lost <= max_lost * chars
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, kept, removed, lost, "\n".join(keep)


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_quality(docs: DataFrame, max_lost: float = 0.4) -> DataFrame:
    """doc_id, the counts, base_failed, kept, lines_removed, chars_removed and the cleaned text of each row.

    Null and empty texts have no words: they fail the base limits and clean to "". Null ids and repeated rows
    stay rows of their own; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = [judge(t.as_py(), max_lost) for t in batch.column(1)[lo : lo + 256]]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 256], *columns], names=["doc_id", *NUMBERS, "base_failed", "kept", "lines_removed", "chars_removed", "cleaned"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", base_failed boolean, kept boolean, lines_removed long, chars_removed long, cleaned string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(common.arrow_map, run, schema)
