"""Variant spellings of organisation names: parsing one name, and whether two spellings agree."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import cache, lru_cache
from itertools import permutations

from stratalog.llm.lookalike import visible_form

#: Words that say what an organisation does; part of its identity.
BUSINESS = (
    "advisors aerospace associates automotive bank brands brothers builders capital chemicals communications construction consulting data dental design distribution "
    "education electronics energy engineering enterprises entertainment equipment finance financial foods fund gas group health healthcare holdings hospitality hotels "
    "industries information insurance interiors international investments laboratories labs laundry logistics management manufacturing marketing materials media medical "
    "metals mining motors networks oil packaging paper partners pharmaceuticals plastics power products properties publishing realty resources restaurants retail sciences "
    "security services software solutions steel storage stores studios supply systems technologies telecom textiles tooldie tools toys trading transport travel trust utilities ventures waste water wireless works"
).split()
#: Short forms that keep too little of their word to be told by rule.
SHORT_FORMS = {"labs": "laboratories", "lab": "laboratories", "mfg": "manufacturing", "mgmt": "management", "mgt": "management", "intl": "international", "bros": "brothers", "sftwr": "software", "hc": "healthcare", "tool": "tooldie", "die": "tooldie"}
#: Longer tokens are no misspelling of any of these words.
_LONGEST = max(map(len, BUSINESS)) + 2
#: Words and initials of legal forms, in any order; no part of the identity.
LEGAL = (
    "llc llp lp inc incorporated corp corporation co company ltd limited liability partnership plc gmbh sarl sa ag nv bv kg kgaa se spa srl pty pte lllp ulc sas ab oy as"
).split()
_DOTTED = re.compile(r"\b(?:[a-z]\.\s?){2,}(?:[a-z]\b)?|\bs\.?\s?a\s?\.?\s?r\.?\s?l\b\.?")
_BRACKETS = re.compile(r"\([^()]*\)?|\[[^\[\]]*\]?")
_ROMAN = re.compile(r"(?=[ivx])(x{0,3})(ix|iv|v?i{0,3})")
#: What an instrument's description begins with, after the name in a schedule line.
INSTRUMENT = (
    r"(?:first|second|third|1st|2nd)[ -]lien|unitranche|senior |subordinated|junior |revolv|delayed[ -]draw|term loan|last[ -]out|first[ -]out|mezzanine|convertible|structured|preferred|common|"
    r"class [a-z]\b|membership|warrant|equity|note|bond|secured|unsecured|loan|line of credit|limited partner interest|series [a-z]\b"
)
_DESCRIPTION = re.compile(rf"\s*(?:\||\s[-–—]\s|[,;–—-])\s*(?:{INSTRUMENT}).*$", re.S)
_BAR = re.compile(r"\s*\|.*$|\s+[—–-]\s+.*$", re.S)


def name_of_line(identifier: str) -> str:
    """The organisation's name in a schedule line: what stands before the instrument."""
    text = visible_form(identifier)
    shorter = re.sub(_DESCRIPTION.pattern, "", text, flags=re.S | re.I)
    return _BAR.sub("", shorter) if shorter == text else shorter


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", visible_form(text)))
    return "".join(x for x in text if unicodedata.category(x) != "Mn").casefold()


def _roman(token: str) -> int | None:
    if token.isdecimal():
        return int(token)
    match = _ROMAN.fullmatch(token)
    if not match:
        return None
    ones = {"": 0, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}
    return 10 * len(match[1]) + ones[match[2]] or None


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words, or most + 1 if more."""
    n, far = len(b), most + 1
    if abs(len(a) - n) > most:
        return far
    # Only the cells within `most` of the diagonal can be low enough.
    before, row = None, {j: j for j in range(min(n, most) + 1)}
    for i, x in enumerate(a, 1):
        two, before, row = before, row, {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            if j == 0:
                row[j] = i
                continue
            y = b[j - 1]
            cost = min(before.get(j, far) + 1, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two.get(j - 2, far) + 1)
            row[j] = cost
        if min(row.values()) > most:
            return far
    return min(row.get(n, far), far)


def _keeps_order(short: str, word: str) -> bool:
    letters = iter(word)
    return all(x in letters for x in short)


def _shortened(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters: two words within so many edits have such a form in common."""
    forms = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        forms = forms | level
    return forms


@cache
def _shortened_business() -> dict[str, list[str]]:
    table: dict[str, list[str]] = {}
    for word in BUSINESS:
        if len(word) >= 6:
            for form in _shortened(word, 1 if len(word) < 9 else 2):
                table.setdefault(form, []).append(word)
    return table


def _misspelled_business(token: str) -> tuple[str, ...]:
    table = _shortened_business()
    near = {w for form in _shortened(token, 2 if len(token) >= 7 else 1) for w in table.get(form, ())}
    costs = {w: distance(token, w, 2) for w in near}
    costs = {w: d for w, d in costs.items() if d <= (1 if len(w) < 9 else 2)}
    return tuple(sorted(w for w, d in costs.items() if d == min(costs.values())))


@lru_cache(maxsize=100_000)
def business_words(token: str, dotted: bool) -> tuple[int, tuple[str, ...]] | None:
    """(rank, words) of the business words a token may stand for: 0 itself, 1 a short form, 2 a misspelling; None if there are none."""
    if token in SHORT_FORMS:
        return 1, (SHORT_FORMS[token],)
    for form in (token, token + "s", token[:-1] + "ies"):
        if form in BUSINESS:
            return 0, (form,)
    if 5 <= len(token) <= _LONGEST and (near := _misspelled_business(token)):
        return 2, near
    if 2 <= len(token) <= _LONGEST:
        begun = tuple(w for w in BUSINESS if w.startswith(token) and len(w) > len(token) + 1)
        if begun and (dotted or len(token) <= 6):
            return 1, begun
        if len(token) <= 7:
            kept = tuple(w for w in BUSINESS if w[0] == token[0] and len(w) > len(token) + 1 and (token[-1] == w[-1] or dotted) and _keeps_order(token, w))
            if kept:
                return 1, kept
    return None


def split_name(text: str, learnt: frozenset[str] = frozenset()) -> tuple[list[str], list[bool], tuple[str, ...], int]:
    """Name words, whether each is cut short by a point, the business words it may have (none: empty) and the series number (0 if none).

    Legal forms, brackets, accents, case, punctuation and look-alike letters do not matter. Words written together stay
    together unless their case tells them apart. Words in `learnt` are business words too.
    """
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z]{2})", " ", "".join(x for x in unicodedata.normalize("NFD", visible_form(text)) if unicodedata.category(x) != "Mn"))
    text = re.sub(r"['’`]", "", _BRACKETS.sub(" ", _plain(text)))
    text = re.sub(r"[&+]|\band\b", " ", text)
    text = _DOTTED.sub(lambda m: re.sub(r"[\s.]", "", m[0]) + " ", text)
    text = re.sub(r"\bs\s?a\s?rl\b", " sarl ", text)
    tokens = [(t, bool(dot)) for t, dot in re.findall(r"([^\W_]+)(\.?)", text) if t != "the"]
    kept: list[tuple[str, bool]] = []
    series, i = 0, 0
    while i < len(tokens):
        token, dot = tokens[i]
        if i + 1 < len(tokens) and token + tokens[i + 1][0] in BUSINESS:
            kept.append((token + tokens[i + 1][0], False))
            i += 2
            continue
        number = _roman(token)
        if number is not None and kept:
            series = number
        elif token not in LEGAL:
            kept.append((token, dot))
        i += 1
    options: tuple[str, ...] = ()
    matches = [(k, (0, (x[0],)) if x[0] in learnt else business_words(*x)) for k, x in enumerate(kept)]
    ranked = [(m[0], -k, m[1]) for k, m in matches if m]
    if ranked and len(kept) > 1:
        rank, at, options = min(ranked)
        gone = {k for k, m in matches if m and m[1] == ("tooldie",)} if options == ("tooldie",) else {-at}
        kept = [x for k, x in enumerate(kept) if k not in gone]
    return [t for t, _ in kept], [d for _, d in kept], options, series


def parse_name(text: str, usual: dict[str, int] | None = None) -> tuple[list[str], list[bool], str, int]:
    """split_name with one business word ('' if none): of several the one with the greatest count in `usual`, then the shortest."""
    words, cuts, options, series = split_name(text)
    return words, cuts, max(options, key=lambda w: ((usual or {}).get(w, 0), -len(w), w), default=""), series


#: How two spellings agree: not at all, by their letters, or only if words of the first, of the second or of either are short forms.
DIFFERENT, SAME, FIRST_SHORT, SECOND_SHORT, BOTH_SHORT = 0, 1, 2, 3, 4


def word_cost(a: str, cut_a: bool, b: str, cut_b: bool) -> tuple[int, int]:
    """Edits between two name words (9: different), and which one is a short form of the other, if only that makes them agree (else SAME)."""
    if a == b:
        return 0, SAME
    short, word = (a, b) if len(a) <= len(b) else (b, a)
    side = FIRST_SHORT if short == a else SECOND_SHORT
    if cut_a and b.startswith(a) or cut_b and a.startswith(b):
        return 0, side
    most = 0 if len(short) < 4 else 1 if len(short) < 7 else 2 if len(short) < 9 else 3
    cost = distance(a, b, most)
    if cost <= most:
        return cost, SAME
    if cut_a != cut_b and len(short) >= 4 and (cut_a if short == a else cut_b):  # a cut word may hold an edit itself
        if any(distance(short, word[: len(short) + k], 1) <= 1 for k in (-1, 0, 1)):
            return 2, side
    if len(short) >= 4 and word.startswith(short):  # cut short without a point
        return 3, side
    return 9, SAME


def _assigned(costs: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest one-to-one assignment of a square table (shortest augmenting paths)."""
    n = len(costs)
    if n == 1:
        return [0]
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j, least, before, seen = i, 0, [1e9] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[j]:
            seen[j] = True
            step, to = 1e9, 0
            for k in range(1, n + 1):
                if not seen[k]:
                    gap = costs[row_of[j] - 1][k - 1] - u[row_of[j]] - v[k]
                    if gap < least[k]:
                        least[k], before[k] = gap, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(n + 1):
                if seen[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j:
            row_of[j] = row_of[before[j]]
            j = before[j]
    columns = [0] * n
    for k in range(1, n + 1):
        columns[row_of[k] - 1] = k - 1
    return columns


def agreement(words_a: list[str], cut_a: list[bool], words_b: list[str], cut_b: list[bool]) -> int:
    """How two spellings (of one business word and series number) agree, however many words they have.

    All words must agree, in any order, with at most three edits over all of them. Words that the other side writes together or
    apart agree if their letters do, with at most two edits, or none below eight letters.
    """
    rest_a, rest_b = [], list(zip(words_b, cut_b))
    if not words_a or not words_b:
        return DIFFERENT
    for a in zip(words_a, cut_a):
        same = next((i for i, b in enumerate(rest_b) if b[0] == a[0]), None)
        if same is None:
            rest_a.append(a)
        else:
            rest_b.pop(same)
    if not rest_a and not rest_b:
        return SAME
    if len(rest_a) == len(rest_b):
        if sum(not c for _, c in rest_a) > 3 + sum(c for _, c in rest_b):  # each pair of whole words costs an edit
            return DIFFERENT
        costs = [[word_cost(*a, *b) for b in rest_b] for a in rest_a]
        chosen = [costs[i][k] for i, k in enumerate(_assigned([[c + 0.01 * (side != SAME) for c, side in row] for row in costs]))]
        if sum(c for c, _ in chosen) > 3:
            return DIFFERENT
        sides = {side for _, side in chosen} - {SAME}
        return BOTH_SHORT if len(sides) > 1 else sides.pop() if sides else SAME
    if not rest_a or not rest_b or any(c for _, c in rest_a + rest_b):
        return DIFFERENT
    a, b = [w for w, _ in rest_a], [w for w, _ in rest_b]
    size_a, size_b = sum(map(len, a)), sum(map(len, b))
    most = 2 if min(size_a, size_b) >= 8 else 0
    if abs(size_a - size_b) > most:
        return DIFFERENT
    orders = lambda words: {"".join(x) for x in permutations(words)} if len(words) <= 4 else {"".join(words), "".join(words[::-1])}
    few, many = sorted((a, b), key=len)
    return SAME if any(distance(x, y, most) <= most for x in {"".join(few), "".join(few[::-1])} for y in orders(many)) else DIFFERENT


def word_keys(words: list[str], cuts: list[bool]) -> list[tuple[str, int]]:
    """The block keys of a spelling, each with the number of the word it comes from (-1: all of them).

    Of each word the whole, its beginning and its end, the latter two with the initials of all words in order of the alphabet, which neither
    order nor short forms change; and beginning and end of all words written together (j). Initials alone (i) serve spellings of nothing but short forms.
    """
    initials = "".join(sorted(w[0] for w in words))
    if len(initials) > 16:
        initials = hashlib.md5(initials.encode()).hexdigest()
    keys = {f"i:{initials}": -1}
    for i, (w, cut) in enumerate(zip(words, cuts)):
        if not cut:
            keys[f"w:{w}" if len(w) >= 4 else f"w:{w}|{initials}"] = i
            keys[f"s:{w[-4:]}|{initials}"] = i
        if len(w) >= 4:
            keys[f"p:{w[:4]}|{initials}"] = i
    if not any(cuts):
        for joined in {"".join(words), "".join(words[::-1])}:
            keys |= {f"j:{joined[:6]}": -1, f"j:-{joined[-6:]}": -1}
    return sorted(keys.items())


#: Letters of a word beyond which its forms are pieces rather than what deletions leave; words that differ in length by edits may have both.
LONG = 24
#: Letters of a cut word that are compared with the beginnings of whole words where it may hold an edit itself.
_BEGUN = 6


def word_forms(word: str, cut: bool) -> list[tuple[str, int]]:
    """Texts of which any two words that may agree (see word_cost) have one in common, with roles as those of blocks: 0 meets 0, 1 meets all, 2 meets 1.

    Two words within so many edits have a form in common that lacks as many letters of each. Of long words one of seven pieces
    of three letters outlives three edits, each of which touches at most two of them, and then stands at most three places off. A short
    form asks for the words that begin with it; if cut by a point, also for those that begin with it but for one edit.
    """
    most = 0 if len(word) < 4 else 1 if len(word) < 7 else 2 if len(word) < 9 else 3
    forms = dict.fromkeys(_shortened(word, most) if len(word) <= LONG + 3 else (), 0)
    if len(word) >= LONG - 2:
        forms |= {f"{i}:{word[3 * i + k : 3 * i + k + 3]}": 2 for i in range(7) for k in range(-3, 4) if 3 * i + k >= 0}
        forms |= {f"{i}:{word[3 * i : 3 * i + 3]}": 1 for i in range(7)}
    forms |= {f"c:{word[:k]}": 2 for k in range(1, min(len(word), LONG) + 1)}
    if cut or len(word) >= 4:
        forms[f"c:{word[:LONG]}"] = 1
    if cut and len(word) >= 4:
        forms |= dict.fromkeys((f"e:{x}" for x in _shortened(word[:_BEGUN], 1)), 1)
    elif len(word) >= 4:
        forms |= {f"e:{x}": 2 for k in range(3, _BEGUN + 2) for x in _shortened(word[:k], 1)}
    return sorted(forms.items())


@cache
def _letter_code(letter: str) -> int:
    return int.from_bytes(hashlib.blake2b(letter.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def letter_forms(words: list[str]) -> set[int]:
    """Codes of the letters of all words in no order, of which two spellings that agree by words written together or apart have one in common.

    Such spellings have the same letters but for two edits, or for none below eight letters. Equal codes of other letters
    only cost a comparison.
    """
    counts = Counter("".join(words))
    whole = sum(n * _letter_code(x) for x, n in counts.items())
    fewer = {whole}
    if counts.total() >= 8:
        fewer |= {whole - _letter_code(x) for x in counts}
        fewer |= {whole - _letter_code(x) - _letter_code(y) for x in counts for y in counts if x != y or counts[x] > 1}
    return {(x + 2**63) % 2**64 - 2**63 for x in fewer}
