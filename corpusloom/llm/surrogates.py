"""Operator 7: personal data replaced by keyed surrogates of the same type and format.

Every replacement is a keyed permutation of the values of one shape, so without a table two different values of a shape never
meet in one surrogate, and one value is replaced alike wherever it stands (in any letter case and, for numbers, with any
separators). Digits stay digits, letters keep script and case, vowels of names stay vowels, accents stay accents, card numbers
and IBANs keep their check digits' validity, e-mail addresses keep their top-level domain, first names are permuted among names
of the same gender and script, and gendered endings of surnames stay. Permutations are Feistel networks over keyed BLAKE2b with
cycle walking. A value without a letter or digit to move gets letters of a keyed hash in its place.

Across the corpus, a check pass gathers the distinct values and their surrogates: values that share a surrogate, or kept
their own value, get new ones (for all but the smallest value of each group) until none is left, and the second pass applies
those exceptions. Full names are checked part by part, so a surname that has to move on does so in full names and alone. From
attempt ``LONGER`` on surrogates get longer, so that also shapes of which nearly all values occur run out of collisions; IP
addresses can't, and keep their last surrogate after ``ATTEMPTS``. By construction exceptions are a handful, so they travel with
the second pass; over ``most_exceptions`` of them (detectors of your own may need it) the pass stops with an error rather than
go on without them.

Defined results: null texts stay null; texts without personal data are unchanged; a password of neither letters nor digits
(``password: ________``) is a blank to fill in and stays; repeated rows are replaced alike; an empty table gives an empty
table; all columns of the input are kept.
"""

from __future__ import annotations

import ipaddress
import itertools
import re
from functools import lru_cache, partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Common first names by script and gender; a person is known by one of these or by a title.
NAMES = {
    ("latin", "f"): (
        "Alice Anna Camille Carmen Claire Elena Emma Hannah Ines Julia Laura Lucia Maria Marie Olivia Sofia Sophie Susan Abigail Amanda Amelia Amy Andrea Angela Anne Ashley Barbara Beatriz Betty Brenda "
        "Carol Caroline Catherine Charlotte Christina Christine Chloe Clara Cynthia Deborah Diana Donna Dorothy Elisabeth Elizabeth Ella Emily Eva Evelyn Fiona Frances Franziska Gabriela Giulia Gloria "
        "Grace Heather Heidi Helen Helena Ingrid Irene Isabel Isabella Jacqueline Jane Janet Jennifer Jessica Joan Johanna Josephine Joyce Judith Julie Karen Katharina Katherine Kathleen Kelly Kimberly "
        "Kristin Lea Lena Linda Lisa Louise Lucy Madison Manon Margaret Marta Martha Mary Megan Melissa Mia Michelle Monica Monika Nancy Natalie Nicole Nina Nora Pamela Patricia Paula Petra Rachel "
        "Rebecca Renate Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Sonia Stephanie Teresa Theresa Ursula Valentina Valerie Vanessa Victoria Virginia Yvonne Zoe "
        "Aisha Amina Ananya Ayesha Fatima Keiko Khadija Layla Leila Mei Ngozi Priya Sakura Sunita Yasmin Yuki Zainab"
    ).split(),
    ("latin", "m"): (
        "Antoine Carlos Daniel David Felix Hans Jack James Jean John Karl Lukas Martin Michael Pablo Paul Peter Robert Thomas Aaron Adam Alan Albert Alejandro Alexander Alfred Andreas Andrew Anthony "
        "Antonio Arthur Benjamin Bernard Brandon Brian Bruce Charles Christian Christopher Claude Daniele Dennis Diego Dieter Donald Douglas Edward Emil Enrique Eric Ernst Ethan Eugene Fernando Francis "
        "Francisco Frank Frederick Friedrich Gabriel Gary George Gerald Gerhard Giovanni Gregory Guillaume Harold Heinrich Helmut Henri Henry Hugo Ivan Jacob Jacques Jason Javier Jeffrey Jerry Joachim "
        "Johannes Jonathan Jorge Jose Joseph Joshua Juan Julien Jürgen Keith Kenneth Kevin Klaus Kurt Larry Lawrence Leon Liam Louis Luca Lucas Luis Manuel Marco Marcus Mario Matthew Matthias Maximilian "
        "Miguel Nathan Nicholas Nicolas Noah Oliver Oscar Otto Patrick Philip Philippe Pierre Rafael Ralph Raymond Ricardo Richard Roger Roland Ronald Russell Ryan Samuel Scott Sebastian Sergio Simon "
        "Stefan Stephen Steven Theodore Timothy Tobias Ulrich Victor Vincent Walter Werner William Wolfgang Xavier Zachary "
        "Abdul Ahmed Ali Arjun Chen Hassan Hiroshi Ibrahim Kenji Khalid Kwame Mohammed Muhammad Mustafa Omar Rahul Raj Ravi Sanjay Takashi Tariq Wei Yusuf"
    ).split(),
    ("cyrillic", "f"): "Анна Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Александра Алина Анастасия Валентина Вера Виктория Галина Евгения Елизавета Ксения Людмила Марина Надежда Нина Полина София Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий Александр Анатолий Антон Артём Борис Василий Виктор Виталий Григорий Денис Евгений Игорь Илья Кирилл Константин Максим Никита Олег Пётр Роман".split(),
}
_FIRST = {name: shape for shape, names in NAMES.items() for name in names}
_CLASSES = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çðñþ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь")
#: Attempts at a surrogate that no other value has, and from which on surrogates get longer.
ATTEMPTS, LONGER = 50, 20
_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz")
_HEX = ("0123456789abcdef",)
_CAP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_SURNAME = rf"(?:(?:[A-Z]['’]|Mc|Mac)?[{_CAP}][{_LOW}]+(?:-[{_CAP}][{_LOW}]+)?)"
_UPPER = rf"(?:[A-Z]['’])?[{_CAP}]{{2,}}(?:-[{_CAP}]{{2,}})?"
_PARTICLES = "von van der den de del da di du la le bin ibn al".split()
_MIDDLE = rf"(?: (?:[{_CAP}]\.|(?:{'|'.join(_PARTICLES)})\b))*"
#: What may follow a first name, in either letter case, and what may stand before one.
_AFTER = {False: re.compile(rf"{_MIDDLE} {_SURNAME}\b"), True: re.compile(rf"{_MIDDLE} {_UPPER}\b")}
_AHEAD = {False: re.compile(rf"(?<![\w-]){_SURNAME}, $"), True: re.compile(rf"(?<![\w-]){_UPPER}, $")}
_CAPITAL = re.compile(rf"(?<![\w-])[{_CAP}][{_CAP}{_LOW}]+(?![\w-])")
_TITLED = re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Mlle)\.? |(?:Miss|Sir|Herrn?|Frau|Señora?|Monsieur|Madame|Signora?|господина?|госпожа|г-н|г-жа) )(?P<who>{_SURNAME}(?: {_SURNAME}){{0,2}})\b")
#: A full name behind words that announce one, or before words that one says.
_CUED = re.compile(rf"(?:(?i:\bmy name is|\bI am|\bsincerely,?|\bregards,?|\bsigned(?: by)?:?|\bwritten by|\bauthor:|\bcontact:?|\bfrom:|\bto:|\battn:?|\bname:|\bpatient:|\bcustomer:) ?\n?)(?P<who>{_SURNAME}(?: [{_CAP}]\.)?(?: {_SURNAME}){{1,2}})\b")
_SAYING = re.compile(rf"(?<![\w.-])(?P<who>{_SURNAME}(?: [{_CAP}]\.)? {_SURNAME}) (?:wrote|said|says|writes|replied|asked|schrieb|sagte|a dit|a écrit|dijo|escribió)\b")
#: Of each of these ways some part stands in every text that it matches, which is quickly looked for.
_CUES = ("ame is", "I am", "i am", "I AM", "ncerely", "NCERELY", "egards", "EGARDS", "igned", "IGNED", "ritten by", "RITTEN", "uthor:", "UTHOR:", "ontact", "ONTACT", "rom:", "ROM:", "o:", "O:", "ttn", "TTN", "ame:", "AME", "atient:", "ATIENT:", "ustomer:", "USTOMER:")
_VERBS = (" wrote", " said", " says", " writes", " replied", " asked", " schrieb", " sagte", " a dit", " a écrit", " dijo", " escribió")
#: Words before a number that make it none of a phone or an address.
_NUMBERED = re.compile(r"(?i)\b(?:version|ver|release|build|firmware|order|invoice|ticket|ref|part|serial|item|isbn|section|chapter|no|nr)[.:#]? ?#?$|(?<!\w)v$")
#: Country calling codes of one and two digits; all others have three.
_CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: What a text must hold for a pattern to match at all, and the pattern; in the order in which they win.
_PATTERNS = (
    ("@", r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
    ("=:", r"(?:(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s*[=:]\s*[\"']?)(?P<secret>(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{8,})"),
    ("0123456789", r"(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])(?!\w))"),
    ("0123456789", r"(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"),
    ("0123456789", r"(?P<iban>(?<![\w.-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-]))"),
    ("+", r"(?P<intl>(?<![\w.-])\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}(?![\w-]))"),
    ("0123456789", r"(?P<phone>(?<![\w.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![\w-]))"),
    ("0123456789", r"(?P<ssn>(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"),
    (":", r"(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:]))"),
)


@lru_cache(16)
def _finder(present: tuple[bool, ...]) -> re.Pattern | None:
    found = [pattern for on, (_, pattern) in zip(present, _PATTERNS) if on]
    return re.compile("|".join(found)) if found else None


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n); without fixed points where n is small."""
    if n < 2:
        return x
    seed = tweak.encode()
    if n < 256:
        return (x + 1 + int.from_bytes(blake2b(seed, key=key, digest_size=8).digest(), "big") % (n - 1)) % n
    half = ((n - 1).bit_length() + 1) // 2
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            mix, bits = b"", 0
            while bits < half:
                mix += blake2b(b"%d.%d." % (r, bits) + right.to_bytes(size, "big") + seed, key=key).digest()
                bits += 512
            left, right = right, left ^ (int.from_bytes(mix, "big") & mask)
        x = left << half | right
        if x < n:
            return x


def _shift(value: str, classes: tuple[str, ...], key: bytes, tweak: str, valid=None) -> str:
    """Permute a string among all of its shape: each character moves inside its class, others stay; letter case is kept.

    ``valid`` walks on to the next string of the shape that has the same truth.
    """
    low = value.lower()
    if len(low) != len(value):
        low = value
    places = [(i, cls) for i, c in enumerate(low) for cls in classes if c in cls]
    shape = "".join(str(next((k for k, cls in enumerate(classes) if c in cls), c)) for c in low)
    number, total = 0, 1
    for i, cls in places:
        number, total = number * len(cls) + cls.index(low[i]), total * len(cls)
    if total < 2:
        return "".join(chr(97 + b % 26) for _, b in zip(value, itertools.cycle(blake2b(f"{tweak}|{value}".encode(), key=key).digest())))
    want = valid(low) if valid else None
    for _ in range(1000):
        number = permute(number, total, key, f"{tweak}|{shape}")
        out, rest = list(low), number
        for i, cls in reversed(places):
            rest, k = divmod(rest, len(cls))
            out[i] = cls[k]
        if valid is None or valid("".join(out)) == want:
            break
    return "".join(o.upper() if v != v.lower() else o for o, v in zip(out, value))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(country: str, account: str) -> int:
    """The check digits that make an IBAN valid: the number is 1 modulo 97 with the country behind the account."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country) + "00") % 97


def _iban(value: str, key: bytes, tweak: str) -> str:
    """The country stays, and whether the check digits are right; wrong ones stay as far from the right ones."""
    country, check, account = value[:2], int(value[2:4]), value[4:]
    new = _shift(account, _LETTERS, key, tweak)
    right = iban_check(country, new)
    off = (check - iban_check(country, account)) % 100
    wrong = (right + off) % 100
    if off and (wrong - right) % 97 == 0:  # 97 more or less is as right
        wrong = (right - off) % 100
    return f"{country}{wrong:02d}{new}"


def _refill(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in value)


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same value."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub("[^0-9]", "", value)
    if kind == "iban":
        return value.replace(" ", "").upper()
    if kind == "phone":  # the number without country code or the 0 that stands for it
        return re.sub("[^0-9]", "", value[len(_country(value)) :])
    if kind == "name":  # letter case and order make no difference
        last, comma, first = value.partition(", ")
        words = (f"{first} {last}" if comma else value).split()
        return " ".join(w.title() if w.isupper() and len(w) > 2 else w for w in words)
    if kind in ("surname", "first"):
        return value.title() if value.isupper() else value
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    return value


def _country(number: str) -> str:
    """The country code with its plus sign, or the trunk 0, with which a phone number begins."""
    if not number.startswith("+"):
        return "0" if re.match(r"0[1-9]", number) else ""
    digits = re.sub("[^0-9]", "", number[:6])
    n = next((n for n in (1, 2) if digits[:n] in _CALLING), 3)
    return re.match(rf"\+(?:[^0-9]*[0-9]){{{n}}}", number)[0]


def _first(word: str) -> str | None:
    """The listed first name that a word is, in capitals or not."""
    return word if word in _FIRST else word.title() if word.isupper() and word.title() in _FIRST else None


def _given(word: str, key: bytes, attempt: int) -> str:
    """A listed first name of the same gender and script, in capitals or not as the word is."""
    first = _first(word)
    names = sorted(NAMES[_FIRST[first]], key=lambda n: blake2b(n.encode(), key=key).digest())
    new = names[(names.index(first) + 1 + attempt) % len(names)]
    return new.upper() if word.isupper() else new


def name_parts(value: str) -> list[tuple[str, str]]:
    """The parts of a name in turn: ``first``, ``surname`` (initials as well), or ``-`` for what stays."""
    tokens, out = re.findall(r"[^\s,]+|[\s,]+", value), []
    for k, word in enumerate(tokens):
        given = _first(word) and (k < len(tokens) - 1 or ", " in value)  # the last word is a surname, if not behind a comma
        out.append(("-" if not word.strip(" ,") or word in _PARTICLES else "first" if given else "surname", word))
    return out


def _surname(word: str, key: bytes, attempt: int) -> str:
    ending = re.search(r"(?:ова|ева|ина|ская|ов|ев|ин|ский)$", word)
    stem = word[: ending.start()] if ending else word
    return _shift(stem, _CLASSES, key, f"name.{attempt}") + (ending.group() if ending else "")


def _lengthened(new: str, kind: str, value: str, key: bytes, more: int) -> str:
    """A surrogate with more letters or digits in front of what has to stay at its end."""
    drawn = int.from_bytes(blake2b(f"{kind}|{canonical(kind, value)}".encode(), key=key).digest(), "big")
    alphabet = "0123456789" if kind in ("card", "phone", "ssn", "iban") else "аеио" if re.search("[а-яё]", new.lower()) else "aeiou"
    extra = "".join(alphabet[drawn // len(alphabet) ** k % len(alphabet)] for k in range(more))
    return extra + new if kind == "email" else new + (extra.upper() if new.isupper() and len(new) > 1 else extra)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0, retry: dict | None = None) -> str:
    """The replacement of one detected value; the parts of a name take their attempts from ``retry``."""
    if kind == "name":
        make = {"-": lambda w: w, "first": lambda w: _given(w, key, 0), "surname": lambda w: surrogate("surname", w, key, retry.get(("surname", canonical("surname", w)), 0) if retry else 0)}
        return "".join(make[part](word) for part, word in name_parts(value))
    new = _replacement(kind, value, key, attempt)
    return _lengthened(new, kind, value, key, 2 * (attempt - LONGER + 1)) if attempt >= LONGER and kind not in ("ip", "ipv6") else new


def _replacement(kind: str, value: str, key: bytes, attempt: int) -> str:
    tweak = f"{kind}.{attempt}"
    if kind == "email":
        local, _, host = value.partition("@")
        host, _, top = host.rpartition(".")
        return f"{_shift(local, _LETTERS, key, tweak)}@{_shift(host, _LETTERS, key, f'host.{attempt}')}.{top}"
    if kind == "ip":
        n = permute(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, key, tweak)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "secret":
        return _shift(value, _HEX if re.fullmatch("[0-9a-f]+", value) else _LETTERS, key, tweak)
    if kind == "surname":
        return _surname(value, key, attempt)
    if kind == "first":
        return _given(value, key, attempt)
    if kind == "ipv6":
        n = permute(int(ipaddress.IPv6Address(value)), 1 << 128, key, tweak)
        return str(ipaddress.IPv6Address(n))
    if kind == "iban":
        new = iter(_iban(canonical(kind, value), key, tweak))
        return "".join(c if c == " " else next(new) for c in value)
    prefix = _country(value) if kind == "phone" else ""
    rest = value[len(prefix) :]
    digits = re.sub("[^0-9]", "", rest)
    return prefix + _refill(rest, _shift(digits, ("0123456789",), key, tweak, luhn if kind == "card" else None))


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of each value, in the order of the text."""
    finder = _finder(tuple(any(c in text for c in chars) for chars, _ in _PATTERNS))
    found = []
    for m in finder.finditer(text) if finder else ():
        kind = {"intl": "phone"}.get(m.lastgroup, m.lastgroup)
        if kind == "ip" and any(int(x) > 255 for x in m["ip"].split(".")) or kind == "ipv6" and not _is_ipv6(m["ipv6"]):
            continue
        if kind == "card" and m["card"].isdigit() and not luhn(m["card"]):  # some other long number: without groups, the check digit has to be right
            continue
        if kind in ("ip", "phone") and _NUMBERED.search(text[max(0, m.start(m.lastgroup) - 12) : m.start(m.lastgroup)]):
            continue
        found.append((kind, m.start(m.lastgroup), m.end(m.lastgroup)))
    free = [(s, e) for _, s, e in found]
    people = [p for p in _people(text) if all(p[2] <= s or p[1] >= e for s, e in free)]
    return sorted(found + people, key=lambda f: f[1])


def _is_ipv6(value: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(value)) and any(c in "0123456789" for c in value)
    except ValueError:
        return False


def _people(text: str) -> list[tuple[str, int, int]]:
    """Full names by a listed first name or by what stands around them, capitalised words after a title, then the same first names and surnames alone in the text."""
    found, stop, surnames, firsts = [], 0, set(), set()
    for m in _CAPITAL.finditer(text):
        s, e, first = m.start(), m.end(), _first(m[0])
        if s < stop or not first:
            continue
        upper = m[0].isupper()
        after = _AFTER[upper].match(text, e)
        while after and _first(text[after.start() : after.end()].split()[-1]) and (more := _AFTER[upper].match(text, after.end())):
            after = more
        last = text[e : after.end()].split()[-1] if after else ""
        if after and last != m[0]:
            e = after.end()
        elif not after and (ahead := _AHEAD[upper].search(text, max(stop, s - 60), s)):
            s, last = ahead.start(), ahead[0][:-2]
            if _first(last):
                continue
        else:
            continue
        found.append(("name", s, e))
        surnames.add(last.title() if upper else last)
        firsts.add(first)
        stop = e
    for pattern, parts in ((_CUED, _CUES), (_SAYING, _VERBS)):
        for m in pattern.finditer(text) if any(p in text for p in parts) else ():
            s, e = m.span("who")
            if all(e <= a or s >= b for _, a, b in found):
                found.append(("name", s, e))
                surnames.add(m["who"].split()[-1])
    for m in _TITLED.finditer(text):
        at = m.start("who")
        for word in m["who"].split():
            if all(at + len(word) <= s or at >= e for _, s, e in found):
                found.append(("surname", at, at + len(word)))
                surnames.add(word)
            at += len(word) + 1
    surnames = {w for w in surnames if len(w) > 2 and not _first(w)}
    if surnames or firsts:
        taken = sorted((s, e) for _, s, e in found)
        alone = re.compile(rf"(?<![\w-])(?:{'|'.join(re.escape(x) for w in sorted(surnames | firsts, key=lambda w: (-len(w), w)) for x in (w, w.upper()))})(?![\w-])")
        k = 0
        for m in alone.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                found.append(("first" if _first(m[0]) in firsts else "surname", *m.span()))
    return found


@tidy
def _entities(batches, key: bytes):
    for batch in batches:
        seen: dict[tuple[str, str], str] = {}
        for text in batch.column(0):
            text = text.as_py()
            for kind, s, e in detect(text):
                for part, value in name_parts(text[s:e]) if kind == "name" else [(kind, text[s:e])]:
                    if part not in ("-", "first"):  # first names move along a list, so no two meet
                        seen.setdefault((part, canonical(part, value)), value)
        rows = [(k, c, canonical(k, surrogate(k, v, key)), v) for (k, c), v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (list(zip(*rows)) or [[]] * 4)], names=["kind", "value", "surrogate", "sample"])


def entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate, sample): the distinct values of all texts, names by their surnames, with what each would be replaced by."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    found = rows.mapInArrow(partial(_entities, key=key), "kind string, value string, surrogate string, sample string")
    return found.groupBy("kind", "value").agg(F.min("surrogate").alias("surrogate"), F.min("sample").alias("sample"))


def collisions(found: DataFrame) -> DataFrame:
    """Values that kept themselves, and all but the smallest of those that share a surrogate."""
    shared = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("low"))
    return found.join(shared, ["kind", "surrogate"]).filter("value = surrogate or n > 1 and value <> low").select("kind", "value", "sample")


def exceptions(docs: DataFrame, key: bytes, text_col: str = "text", most: int = 100_000) -> dict[tuple[str, str], int]:
    """(kind, value) -> attempt for the values whose first surrogate collides; repeated until nothing collides."""
    from .common import written

    found = written(entities(docs, key, text_col), "entities")
    out: dict[tuple[str, str], int] = {}
    for attempt in range(1, ATTEMPTS):
        bad = collisions(found).limit(most + 1).collect()
        if len(bad) + len(out) > most:
            raise ValueError(f"more than {most} values collide: use a key or detectors with larger domains")
        if not bad:
            break
        out |= {(r.kind, r.value): attempt for r in bad}
        new = docs.sparkSession.createDataFrame([(r.kind, r.value, canonical(r.kind, surrogate(r.kind, r.sample, key, attempt))) for r in bad], "kind string, value string, renewed string")
        found = written(found.join(F.broadcast(new), ["kind", "value"], "left").select("kind", "value", F.coalesce("renewed", "surrogate").alias("surrogate"), "sample"), "entities")
    return out


def replace(text: str, key: bytes, retry: dict, make=surrogate) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was replaced."""
    parts, at, kinds = [], 0, []
    for kind, s, e in detect(text):
        value = text[s:e]
        parts += [text[at:s], surrogate(kind, value, key, 0, retry) if kind == "name" else make(kind, value, key, retry.get((kind, canonical(kind, value)), 0) if retry else 0)]
        at = e
        kinds.append(kind)
    return ("".join([*parts, text[at:]]), kinds) if kinds else (text, kinds)


@tidy
def _replaced(batches, key: bytes, retry: dict):
    make = lru_cache(100_000)(surrogate)
    for batch in batches:
        rows = [(None, []) if t is None else replace(t, key, retry, make) for t in (x.as_py() for x in batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["row", "text", "kinds"])


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", kinds_as: str | None = None, most_exceptions: int = 100_000) -> DataFrame:
    """``docs`` with surrogates in place of personal data; with ``kinds_as``, also the kinds replaced, in the order of the text."""
    retry = exceptions(docs, key, text_col, most_exceptions)
    others = [c for c in docs.columns if c != text_col]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(packed.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(partial(_replaced, key=key, retry=retry), f"row {rows.schema['row'].dataType.simpleString()}, text string, kinds array<string>")
    out = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*out, *([F.col("kinds").alias(kinds_as)] if kinds_as else []))
