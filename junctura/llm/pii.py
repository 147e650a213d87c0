"""PII: surrogate generation.

Detected entities get keyed surrogates of their own type: a surrogate follows from a keyed hash of the entity alone, so each
mention of an entity gets the same one in all documents (coreference). It keeps the format: digits stay digits, letters letters of
their script and case, marks stay; cards keep a valid check digit, addresses valid octets, names the gender that a title or a known
first name tells. First and family names are keyed apart, so "Mr John Smith" and "Mr Smith" share a family name. A check over all
distinct entities, on the strings that are shown, finds surrogates that two entities share, that are themselves entities of the corpus (but for
first names, which people share anyway) or that are the entity itself; all but the smallest of those that share are keyed again, until every surrogate is distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import storage

#: Entities with a surrogate of a later attempt that are broadcast at most; above it they are joined.
BROADCAST_ROWS = 200_000

#: First names by script and gender, as fixed values.
NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sophie Claire Camille Elena Lucia Carmen Isabel Sarah Emily Olivia Grace Hannah Katharina Greta Ingrid Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Margaret Monika Petra Sabine Nathalie Marie Ana".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Paul Martin Lukas Felix Jonas Pierre Louis Antoine Carlos Miguel Javier Diego Andreas William Richard Joseph Charles Daniel Matthew Anthony Steven George Edward Hans Klaus Wolfgang Jean Luis Pedro".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Δέσποινα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Ιωάννης Παναγιώτης".split(),
}
#: Syllables of surrogate family names by script, as fixed values.
SYLLABLES = {
    "latin": "bar bel dan dor fen gal har jor kel lan mar nor pel ran sol tar vel wen yor zan".split(),
    "cyrillic": "бар вел гор дан жел зар кал лен мор нов пол рос сав тар фед хар шев юр".split(),
    "greek": "βαλ γερ δημ καλ λαμ μαν νικ παπ ραλ σαβ ταλ φωτ".split(),
}
#: Endings of first names that are made of syllables, by script and gender, as fixed values.
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий", ("greek", "f"): "α", ("greek", "m"): "ος"}
#: Attempts after which the local part of an address gets longer, as its format may have too few strings.
LONGER_AFTER = 3
_KNOWN = {n: (script, gender) for (script, gender), names in NAMES.items() for n in names}
#: Titles and the gender that they tell, as fixed values.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΆΈ-ΏΑ-Ω", "a-zß-öø-ÿа-яёά-ώ"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w.+])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![0-9][\x20.-])(?=0[1-9](?:[\x20.-]?[0-9]){8,9}(?![\x20.-]?[0-9]))0[1-9][0-9]{0,3}(?:[\x20.-][0-9]{2,4}){2,4})(?![\w-])"),
}
_NAME = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\.?\x20)?(?P<first>[{_UP}][{_LOW}]+)\x20(?P<last>[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?)(?!\w)")
_TITLED = re.compile(rf"(?<!\w)(?P<title>{'|'.join(t for t in TITLES)})\.?\x20(?P<last>[{_UP}][{_LOW}]+)(?!\w)")
KINDS = (*PATTERNS, "name")


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def script_of(text: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", text) else "greek" if re.search("[Ͱ-Ͽ]", text) else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, norm of the entities of a text, in order, none within another. norm is what mentions of one entity share."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in PATTERNS["email"].finditer(text)]
    if re.search(r"[0-9]", text):
        found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in PATTERNS["iban"].finditer(text) if _iban_valid(m[0])]
        for m in PATTERNS["card"].finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if luhn(digits) and len(set(digits)) > 1:
                found.append((m.start(), m.end(), "card", digits))
        found += [(m.start(), m.end(), "ssn", m[0]) for m in PATTERNS["ssn"].finditer(text)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in PATTERNS["ip"].finditer(text)]
        found += [(m.start(), m.end(), "phone", re.sub(r"[^0-9]", "", m[0])) for m in PATTERNS["phone"].finditer(text)]
    at = 0
    while m := _NAME.search(text, at):
        if m["title"] or m["first"] in _KNOWN:
            found.append((m.start("first"), m.end(), "name", f"{TITLES.get(m['title'] or '', '') or _KNOWN.get(m['first'], ('', ''))[1]}|{m['first']} {m['last']}"))
            at = m.end()
        else:  # the second word may be a first name
            at = m.start("last")
    for m in _TITLED.finditer(text):
        found.append((m.start("last"), m.end(), "name", f"{TITLES[m['title']]}|{m['last']}"))
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def parts(kind: str, norm: str) -> list[tuple[str, str]]:
    """kind and norm of what is keyed for an entity: first and family name of a person apart, all else as a whole."""
    if kind != "name":
        return [(kind, norm)]
    gender, _, name = norm.partition("|")
    first, _, family = name.rpartition(" ")
    return [("first", f"{gender}|{first}"), ("family", family)] if first else [("family", family)]


class Stream:
    """Numbers that follow from a key and an entity."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.key, self.seed, self.n, self.held = key, f"{kind}\0{attempt}\0{norm}".encode(errors="surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.seed + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return x * n >> 32

    def like(self, text: str) -> str:
        """text with other digits and ASCII letters, all else as it is."""
        return "".join(chr(48 + self.below(10)) if "0" <= c <= "9" else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate of one of parts(), as it is shown but for marks and blanks."""
    s = Stream(key, kind, norm, attempt)
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        at = Stream(key, "domain", domain, 0)  # addresses of one domain stay together
        more = "".join(chr(97 + s.below(26)) for _ in range(attempt - LONGER_AFTER))
        return f"{s.like(local)}{more}@{'.'.join([*(at.like(x) for x in labels[:-1]), labels[-1]])}"
    if kind == "card":
        body = norm[0] + s.like(norm[1:-1])
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = s.like(norm[4:])
        return f"{norm[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + norm[:2] + '00')) % 97:02d}{body}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "phone":
        return "".join(c if k < len(norm) - 7 and k < 3 and len(norm) > 10 else s.like(c) for k, c in enumerate(norm))
    if kind == "ssn":
        return f"{100 + s.below(565):03d}-{1 + s.below(99):02d}-{1 + s.below(9999):04d}"
    if kind == "first":
        gender, _, name = norm.partition("|")
        script, gender = script_of(name), gender or "fm"[s.below(2)]
        if attempt == 0:
            return NAMES[script, gender][s.below(len(NAMES[script, gender]))]
        return _made(s, script, 1 + attempt).capitalize() + ENDINGS[script, gender]
    return _made(s, script_of(norm), 3 + attempt).capitalize()  # the space grows until no names collide


def _made(s: Stream, script: str, syllables: int) -> str:
    return "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(syllables))


def rendered(kind: str, mention: str, norm: str) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind in ("card", "phone"):
        digits = iter(norm)
        return re.sub(r"[0-9]", lambda m: next(digits), mention)
    if kind == "iban":
        chars = iter(norm)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind == "email":
        return norm.upper() if mention.isupper() else norm
    return norm


def _distinct(docs: DataFrame, text: str) -> DataFrame:
    """kind, norm of the parts of all entities, once each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(sorted({x for t in b["t"] if t for _, _, kind, norm in entities(t) for x in parts(kind, norm)}), columns=["kind", "norm"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInPandas(run, "kind string, norm string").distinct()


def _keyed(found: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(surrogate=[surrogate(key, k, n, a) for k, n, a in zip(b["kind"], b["norm"], b["attempt"])])

    return found.select("kind", "norm", "attempt").mapInPandas(run, "kind string, norm string, attempt int, surrogate string")


def surrogates(docs: DataFrame, key: bytes, text: str = "text", rounds: int = 40) -> DataFrame:
    """kind, norm, attempt, surrogate of the parts of all entities of all documents; no two of a kind share a surrogate, and none is an entity."""
    own = F.substring_index("norm", "|", -1)  # a first name's gender is not shown
    with storage.tables(docs.sparkSession) as held:
        found = held.stored(_distinct(docs, text), "entities")
        now = held.stored(_keyed(found.withColumn("attempt", F.lit(0)), key), "surrogates")
        taken = found.filter("kind <> 'first'").select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
        for _ in range(rounds):
            first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"), F.max(F.col("surrogate") == own).alias("same"))
            clashing = first.join(taken, ["kind", "surrogate"], "left").filter("n > 1 or real or same").select("kind", "surrogate", "real", F.col("first.norm").alias("keeps"))
            moves = F.coalesce("real", F.lit(False)) | (F.col("norm") != F.col("keeps")) | (F.col("surrogate") == own)
            again = held.stored(now.join(clashing, ["kind", "surrogate"]).filter(moves).select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "again")
            if not again.limit(1).count():
                return storage.stored(now, "surrogates")
            rest = now.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti")
            now = held.stored(rest.unionByName(_keyed(again, key)), "surrogates")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace_pii(docs: DataFrame, key: bytes = b"junctura", text: str = "text") -> DataFrame:
    """All columns of docs with surrogates in ``text``, and ``pii``: array of kind, start, end (code points of the text given) and surrogate.

    An existing column ``pii`` is replaced. Null texts stay null and have none; rows are handled one by one, so repeated rows get equal results. The key
    is secret in production: who has it can test a guess.
    """
    table = surrogates(docs.select(text), key, text)
    later = table.filter("attempt > 0").select("kind", "norm", "surrogate")
    spans = "array<struct<kind:string,start:int,end:int,surrogate:string>>"
    rows = docs.drop("pii")
    name = storage.free_name("_replaced", rows)

    def replaced(t: str | None, known: dict) -> tuple[str | None, list]:
        if t is None:
            return None, []
        out, at, listed = [], 0, []
        of = lambda x: known.get(x) or surrogate(key, *x)
        for a, b, kind, norm in entities(t):
            new = rendered(kind, t[a:b], " ".join(of(x) for x in parts(kind, norm)))
            out += [t[at:a], new]
            at = b
            listed.append({"kind": kind, "start": a, "end": b, "surrogate": new})
        return "".join([*out, t[at:]]), listed

    if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.norm): r.surrogate for r in later.collect()})

        def by_shared(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replaced(t, shared.value) for t in texts], columns=["t", "s"])

        made = F.pandas_udf(by_shared, f"t string, s {spans}")(F.col(text).cast("string"))
        filled = rows.withColumn(name, made)
    else:
        filled = _joined(rows, text, name, later, replaced, spans)
    return filled.select(*(F.col(f"{name}.t").alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns), F.col(f"{name}.s").alias("pii"))


def _joined(rows: DataFrame, text: str, name: str, later: DataFrame, replaced, spans: str) -> DataFrame:
    """As by broadcast, with the later attempts joined to the rows that have such entities."""
    row = storage.free_name("_row", rows)
    numbered = storage.stored(rows.withColumn(row, F.monotonically_increasing_id()), "rows")

    def mentions(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "norm": n} for k, n in sorted({x for _, _, kind, norm in entities(t or "") for x in parts(kind, norm)})] for t in texts])

    listed = numbered.select(row, F.explode(F.pandas_udf(mentions, "array<struct<kind:string,norm:string>>")(F.col(text).cast("string"))).alias("x")).select(row, "x.kind", "x.norm")
    of_row = listed.join(later, ["kind", "norm"]).groupBy(row).agg(F.collect_list(F.struct("kind", "norm", "surrogate")).alias("_later"))
    joined = numbered.join(of_row.withColumnRenamed("_later", name), row, "left")

    def by_row(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replaced(t, {(x["kind"], x["norm"]): x["surrogate"] for x in (k if k is not None else [])}) for t, k in zip(texts, known)], columns=["t", "s"])

    return joined.withColumn(name, F.pandas_udf(by_row, f"t string, s {spans}")(F.col(text).cast("string"), F.col(name))).drop(row)
