"""Defective prompt and reply pairs (problem 1).

Replies are aligned with their prompt by word shingles and longest common
subsequence (copies), with refusal templates by longest common subsequence
(refusals), and compared with it in language by function words.  A reply that
lacks a final mark is cut when its last words are rarely followed by an end:
the counts of word-class contexts over all replies of both tables give that share.

One pass settles what needs no counts and writes the contexts that the other replies
ask about; a second counts these contexts (a sieve of at most ``SIFT_BITS`` bits leaves
out the others) and all words; the counts are joined to the replies that ask.

Defined results: null, empty and unreadable messages, and conversations whose
last turn is not answered, are ``empty``; a stored string that is cut short is
``truncated`` only; a null reply is ``empty``; other columns are ignored;
repeated deliveries and ties give one row.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.chat import parse
from skein.llm.lexicon import FUNCTION_WORDS
from skein.operators.workspace import shared_folder

ENOUGH, SOME = (20, 20, 20, 25, 40), 8  # times that a context of each length is seen to be believed; where half of them are ends
VOCABULARY = 2  # times that a word of the vocabulary is seen
RARELY = 0.03  # share of ends below which a reply is cut
SIFT_BITS = (1 << 16, 1 << 28)  # least and most bits of the sieve of contexts asked about: at most 32 MB
MAX_LEAD = 6  # words a lead-in may have
REST_WORDS = 8  # words of a refusal that may say something else
ASKED_SCHEMA = "row_id bigint, field string, defect string, tail string, foreign boolean, keys array<bigint>"

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(r"(?<=\n)\d{1,2}[.)](?=\s|$)|\w+(?:_\w+)+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|\n+|[^\w\s]|_")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*[\"'”»)]*|[.!?]+")

# What stands in for a reply that is not there.
STAND_INS = frozenset("na none null nil nan todo tbd blank empty noanswer noresponse noreply nothing undefined answer response reply placeholder missing nodata nocontent notavailable notapplicable nooutput".split())

# Wordings by which a reply declines; each is aligned as a whole.
REFUSALS = tuple(
    tuple(x.split())
    for x in """i can't help with that
i can't do that
i cannot help with
i can't assist with
i am unable to help with
i am not able to answer questions about
i must decline to say anything on
i have to decline
i won't be discussing that
that is something i have to pass on
it would not be appropriate for me to talk about
there is nothing i am permitted to share about
you will need to ask somebody else about
that is off limits here
the request concerning was declined
i have to say no to this request
go unanswered sorry ask me anything but
nothing i say about that would be allowed so i will stop here
no comment from my side
your question falls outside what i may answer
this is outside what i may discuss
no i will not answer this one
aren't available from me
this assistant does not deal with questions on
i'd rather leave that alone
i do not feel comfortable going into that
let's talk about something other than
i'm not comfortable with
i cannot comment on
i refuse to
sorry no
je ne peux pas répondre à cette question
je ne peux pas vous aider
il ne m'est pas possible de vous aider
no puedo ayudar con esa pregunta
no puedo responder
no me está permitido responder
diese frage darf ich leider nicht beantworten
dabei kann ich nicht helfen
das kann ich nicht beantworten
non posso rispondere a questa domanda
non posso aiutare
não posso ajudar com
não posso responder
daar kan ik niet mee helpen
daar kan ik helaas niet op antwoorden
die vraag kan ik niet beantwoorden
я не могу ответить на этот вопрос
я не могу помочь с
к сожалению я не могу""".splitlines()
)
_CLOSERS = re.compile(
    r"(?i)guidelines|consult a|another topic|anything else|(?:i'm|i am) sorry|apolog|regret|unfortunately|somebody else|someone else|jemand anderen|désolé|lo siento|leider|mi dispiace|desculp|helaas|прост"
)
_FOUND_NOTHING = re.compile(r"(?i)\b(?:passage|text|context)\b")
# Wordings of requests for harm or deceit.
HARM = re.compile(
    r"(?i)\bpoison\b|\bbombs?\b|\bexplosives?\b|\bsteal\b|\bhack\b|\bblackmail|\bstalk\b|\bforge\b|\bcounterfeit|\bscam\b|\bdefraud|\blaunder|\bsabotage|\bimpersonat|\bharass|\bbully\b|\bdeceive|\bsmuggl"
    r"|\b(?:open|break into|enter|pick)\b.{0,40}\b(?:neighbour|neighbor|someone|stranger|colleague)s?\b.{0,40}\b(?:locked|shed|house|door|car|at night)|\bfollow\b.{0,60}\bwithout\b.{0,20}\bseen\b"
    r"|\bread\b.{0,30}\bprivate\b|\bcopy\b.{0,30}\b(?:badge|key|card|signature)\b|\bspread\b.{0,30}\b(?:rumou?r|lie)s?\b|\btrick\b.{0,60}\b(?:savings|money|relative)\b|\bwithout (?:getting|being) caught\b"
)
_IMPERATIVE = re.compile(
    r"(?i)^(?:please |linux command, please|which |what |why |how |who |when |where |can |could |explain|tell|write|draft|brainstorm|describe|give|list|summari[sz]e|compose|create|suggest|name|show|find|make|fix|rewrite|correct|translate|change|solve|work|answer|read|use|look|boil|i need|compare|help)"
)
_REWORK = re.compile(r"(?i)\s*(?:please )?(?:fix|rewrite|correct|change|make|translate|simplif|edit|paraphras|improve|summari|shorten|proofread|convert)")
_TRANSLATE = re.compile(r"(?i)translat|übersetz|traduis|tradui|traduz|traduc|vertaal|перевед|\b(?:in|into|to|auf|en|em|in het) (?:english|german|french|spanish|italian|portuguese|dutch|russian|deutsch|français|español|italiano|português|nederlands)\b|say .{0,40} in (?:english|german|french|spanish|italian|portuguese|dutch|russian)")
_CODE = re.compile(r"\s*(?:select|insert|update|delete|create|with)\s.*\b(?:from|into|table|set)\b|\s*(?:def|class|import|find|grep|tail|head|tar|cut|awk|sed|ls|cat|sort|docker|git|curl|ps|du|df|chmod|chown|mkdir|rm|cp|mv|wc|xargs|sudo|echo|ssh|rsync)\s", re.I | re.S)
_SHARED = Counter(w for words in FUNCTION_WORDS.values() for w in set(words))
_LANG = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words):
        if len(_w) > 1 or _SHARED[_w] == 1:
            _LANG.setdefault(_w, []).append((_lang, 1.0 / _SHARED[_w] ** 2))
_FUNCTION = frozenset(_SHARED)


def is_code(text: str) -> bool:
    return "```" in text or _CODE.match(text) is not None


def words_of(text: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(text.lower())]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, by bit rows."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = masks.get(w, 0) | row
        row = x & (x ^ (x - ((row << 1) | 1)))
    return row.bit_count()


# ---------------------------------------------------------------- empty


def is_empty(reply: str | None, words: list[str] | None = None) -> bool:
    """No reply, nothing but blanks or signs, or a stand-in for one, which may be repeated."""
    if reply is None or not reply.strip():
        return True
    words = words_of(reply) if words is None else words
    if not words:
        return not _PICTURE.search(reply)
    if len(words) > 4 and len(set(words)) > 4:
        return False
    return "".join(words) in STAND_INS or "".join(dict.fromkeys(words)) in STAND_INS


_PICTURE = re.compile(r"[←-⯿\U0001f000-\U0001faff]")


# ---------------------------------------------------------------- truncated


def _class(t: str) -> str:
    """Word class of a token: closed-class words as they are, others by shape."""
    low = t.lower()
    if t[0] == "\n":
        return "\n"
    if t[-1] in ".)" and len(t) > 1 and t[0].isdigit():
        return "#."
    if "_" in t and len(t) > 1:
        return "id"
    if low in _FUNCTION or not t[0].isalnum():
        return low
    if t[0].isdigit():
        return "#"
    if t[0].isupper():
        return "C"
    return "wd" if low.endswith("ed") else "wl" if low.endswith("ly") else "ws" if low.endswith("s") else "w"


def classes(text: str) -> list[str]:
    """Word classes of the tokens."""
    return [_class(t) for t in _TOKEN.findall(text)]


def _contexts(tags: list[str], i: int, start: int) -> tuple:
    """Keys of the state before token i of a sentence that begins at start, longest first; the last classes may be those before it."""
    own = tags[start:i]
    head = own[0] if own else ""
    if len(own) > 2 and "," in own[1:3]:  # an opening such as "However," says nothing of the rest
        at = own.index(",", 1)
        head = own[at + 1] if at + 1 < len(own) else ""
    tail = tuple(tags[max(0, i - 5) : i])  # a name on a line of its own is told from one that opens a sentence
    return ((head, *tail[-5:]), (head, *tail[-4:]), (head, *tail[-3:]), tail[-3:], tail[-2:])


_STOP = frozenset(".!?…。")
_BREAK = _STOP | {"\n"}  # a line ends what stands on it, a list entry as a sentence


class Boundaries:
    """How often a state is followed by an end of the sentence or reply."""

    def __init__(self):
        self.seen: Counter = Counter()
        self.ends: Counter = Counter()
        self.vocabulary: Counter = Counter()
        self.stems: set[str] = set()

    def add(self, reply: str) -> None:
        tags = classes(reply)
        start, n = 0, len(tags)
        closed = n and (tags[-1] in _STOP or tags[-1] in "\"'”»)`;")
        for i in range(1, n + 1):
            if i == n and not closed and n > 1 and tags[-1] not in ("C", "w", "ws", "#", "id"):
                break  # may itself be cut
            at_end = i == n or tags[i] in _BREAK
            if i > start:
                for key in _contexts(tags, i, start):
                    self.seen[key] += 1
                    if at_end:
                        self.ends[key] += 1
            if i < n and tags[i] in _BREAK:
                start = i + 1
        words = _WORD.findall(reply)
        self.vocabulary.update(words if closed else words[:-1])  # a last word without a mark may itself be cut

    def finish(self, least: int = 3) -> "Boundaries":
        self.seen = Counter({k: n for k, n in self.seen.items() if n >= least})
        self.ends = Counter({k: n for k, n in self.ends.items() if k in self.seen})
        self.vocabulary = Counter({w.lower(): n for w, n in self.vocabulary.items() if n >= VOCABULARY})
        self.stems = {w[:k] for w in self.vocabulary for k in range(2, len(w))}
        return self

    def end_share(self, tags: list[str]) -> float | None:
        """Share of ends after the whole of tags, by the longest context seen often, or mostly before an end; None where nothing like it was seen."""
        for key, enough in zip(_last_contexts(tags), ENOUGH):
            if self.seen[key] >= enough or (self.seen[key] >= SOME and 2 * self.ends[key] >= self.seen[key]):
                return self.ends[key] / self.seen[key]
        return None


def _last_contexts(tags: list[str]) -> tuple:
    """Keys of the state after the whole of tags."""
    start = 0
    for i, t in enumerate(tags[:-1]):
        if t in _BREAK:
            start = i + 1
    return _contexts(tags, len(tags), start)


# Contexts as 64-bit keys: a polynomial of the hashes of the classes from the last one back, mixed.
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(8)]
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


@lru_cache(1 << 16)
def _hash(tag: str) -> int:
    return int.from_bytes(blake2b(tag.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def context_keys(tags: list[str]) -> list[int]:
    """The contexts of the end of tags, longest first, as signed 64-bit keys."""
    sums = [sum(_hash(t) * _POWERS[m + 1] for m, t in enumerate(reversed(key))) % (1 << 64) for key in _last_contexts(tags)]
    return _mixed(np.array(sums, np.uint64)).view(np.int64).tolist()


class Tally:
    """The counts of ``Boundaries`` over many replies at once, of the contexts that a sieve holds."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (8 * len(bits) - 1).bit_length())
        self.names: dict[str, int] = {}  # classes, numbered
        self.memo: dict[str, int] = {}  # class of a token
        self.hashes = np.zeros(0, np.uint64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: Counter = Counter()

    def add(self, replies: list[str]) -> None:
        tags, sizes, memo, names = [], [], self.memo, self.names
        if len(memo) > 1 << 18:
            memo.clear()
        for reply in replies:
            tokens = _TOKEN.findall(reply)
            for t in tokens:
                k = memo.get(t)
                if k is None:
                    k = memo[t] = names.setdefault(_class(t), len(names))
                tags.append(k)
            sizes.append(len(tokens))
            words = _WORD.findall(reply)
            closed = tokens and (tokens[-1] in _STOP or tokens[-1] in "\"'”»)`;")
            self.words.update(words if closed else words[:-1])  # a last word without a mark may itself be cut
        n = len(tags)
        if not n:
            return
        name = list(names)
        if len(self.hashes) != len(name) + 1:
            self.hashes = np.array([_hash(x) for x in [*name, ""]], np.uint64)
        flag = lambda some: np.array([x in some for x in name])
        t = np.array(tags, np.int64)
        size = np.array([k for k in sizes if k], np.int64)
        last = np.cumsum(size) - 1
        first = last - size + 1
        at = np.arange(n)
        is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
        is_first[first], is_last[last] = True, True
        stops = flag(_BREAK)[t]
        start = np.maximum.accumulate(np.where(is_first, at, np.where(stops, at + 1, 0)))
        end = is_last.copy()
        end[:-1] |= stops[1:] & ~is_last[:-1]
        # the last place of a reply without a mark counts only after a word that may end it
        unsure = ~flag({*_STOP, *"\"'”»)`;", "C", "w", "ws", "#", "id"})[t] & is_last & ~is_first
        use = np.flatnonzero((start <= at) & ~unsure)
        start, end = start[use], end[use]
        own, before = use - start + 1, use - np.repeat(first, size)[use] + 1
        none, comma = len(name), names.get(",", -1)
        head = t[start]
        long = np.flatnonzero(own > 2)
        for step in (2, 1):  # an opening with a comma: the class after its first one
            hit = long[t[start[long] + step] == comma]
            after = start[hit] + step + 1
            head[hit] = np.where(after <= use[hit], t[np.minimum(after, n - 1)], none)
        h, hh = self.hashes[t], self.hashes[head]
        powers = np.array(_POWERS, np.uint64)
        sums, total = {}, np.zeros(len(use), np.uint64)
        for m in range(1, 6):
            total = total + np.where(before >= m, h[np.maximum(use - m + 1, 0)] * powers[m], np.uint64(0))
            sums[m] = total
        keys = [sums[m] + hh * powers[np.minimum(before, m) + 1] for m in (5, 4, 3)] + [sums[3], sums[2]]
        key = _mixed(np.concatenate(keys))
        place = key >> self.shift
        held = np.flatnonzero(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
        self.parts.append((key[held], np.ones(len(held), np.int64), np.tile(end, 5)[held].astype(np.int64)))
        if sum(len(k) for k, _, _ in self.parts) > 1 << 21:
            self.parts = [self.gathered()]

    def gathered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, times seen, times before an end) so far."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, back = np.unique(np.concatenate([k for k, _, _ in self.parts]), return_inverse=True)
        return key, *(np.bincount(back, weights=np.concatenate([p[k] for p in self.parts]), minlength=len(key)).astype(np.int64) for k in (1, 2))


_DANGLING = frozenset("the a an of and to in or for with by from that which its their his her my your our than but as at on into if when while because although though each every no not some is are was were be been has have had will would can could must may should do does did just must between through under over without".split())


def _foreign(tail: str, text: str) -> bool:
    """Whether a word is a closed-class word of other languages than that of the text, as the beginning of a longer word may be."""
    own = [lang for lang, _ in _LANG.get(tail, ())]
    return bool(own) and language_of(words_of(text)[:-1])[0] not in (*own, None)


def ending(reply: str, prompt_words: list[str] | tuple = ()) -> bool | tuple[str | None, bool, list[str]]:
    """Whether the reply stops short, or what the counts must say: (last word where it may be the beginning of a longer one, whether it is foreign, classes)."""
    text = reply.rstrip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\(?\d{1,2}[.)])$", text):
        return True
    last = text[-1]
    code = is_code(text)
    if last in ".!?" and not code and text.rfind("(") <= text.rfind(")"):
        return False
    body = re.sub(r"(?<=\w)['’](?=\w)", "", text)
    if code:
        if body.count("'") % 2 or body.count('"') % 2 or body.count("(") > body.count(")") or body.count("{") > body.count("}"):
            return True
        if last in "|,&\\=+-(/*<":
            return True
    elif last in ",:;-–—(/&":
        return True
    elif body.rfind("(") > body.rfind(")") and not re.search(r"[:;]\($", body):
        return True
    if last in ".!?…\"'”»)]}" and not code or last == ";":
        return False
    words = _WORD.findall(text)
    if not words:
        return False
    tail = words[-1].lower()
    if not code and tail in _DANGLING:
        return True
    glued = text.endswith(words[-1])
    part = glued and len(words) > 3 and not any(c.isdigit() for c in tail) and len(tail) > 1 and tail not in prompt_words
    return tail if part else None, part and _foreign(tail, text), classes(text)


def is_truncated(reply: str, model: Boundaries, prompt_words: list[str] | tuple = ()) -> bool:
    """Whether the reply stops within a sentence, word, list entry, command or bracket."""
    asks = ending(reply, prompt_words)
    if isinstance(asks, bool):
        return asks
    tail, foreign, tags = asks
    if tail in model.stems and (tail not in model.vocabulary or foreign):
        return True
    share = model.end_share(tags)
    return share is not None and share < RARELY


# ---------------------------------------------------------------- refusal


_SPREAD = Counter(w for t in REFUSALS for w in set(t))
#: words of which one must stand in a reply for a template to run through it
_KEYS: dict[str, list[tuple[str, ...]]] = {}
for _t in REFUSALS:
    for _w in sorted(set(_t), key=lambda w: (w in _FUNCTION, _SPREAD[w], w))[: 1 if len(_t) < 5 else 2 if len(_t) < 9 else 3]:
        _KEYS.setdefault(_w, []).append(_t)


def _aligned(words: list[str], longer_than: int = 0) -> bool:
    """Whether a template runs through the words in order, nearly whole and close together."""
    for template in {t for w in set(words) for t in _KEYS.get(w, ())}:
        n = len(template)
        if n <= longer_than or (n >= 5 and len(words) > 3 * n + 12):
            continue
        if n < 5:
            if any(tuple(words[i : i + n]) == template for i in range(len(words) - n + 1)):
                return True
        elif lcs(list(template), words) >= (n - 1 if n < 9 else n - 2):
            return True
    return False


def is_refusal(prompt: str, reply: str, whole: list[str] | None = None) -> bool:
    """The reply as a whole declines a request that it should have met."""
    if whole is None:
        whole = words_of(reply)
    if not any(w in _KEYS for w in whole):
        return False
    # words that neither decline nor close: a lead-in, or as many in ten of a wordy refusal
    spare = max(REST_WORDS, len(whole) // 10)
    declined, rest = False, 0
    for m in _SENTENCE.finditer(reply):
        s = m[0].strip()
        if not s.strip(" .!?\"'"):
            continue
        if rest > max(14, spare):
            return False
        words = words_of(s)
        quoted = re.search(r"[\"“«].{3,}[\"”»]", s)
        if not quoted and _aligned(words):
            declined = True
        elif not _CLOSERS.search(s):
            rest += len(words)
    if not declined:
        declined = rest <= 14 and _aligned(whole, 6)
        rest = 0 if declined else rest
    if not declined or rest > spare or re.match(r"(?i)\s*(?:dear|hi|hello) [^\n]*\n", reply):
        return False
    return not HARM.search(_request(prompt)) and not _lacks_answer(prompt)


_PASSAGE = re.compile(r"(?is)(?:passage|text|context)\s*:\s*(.+?)\n\s*question\s*:\s*(.+)$")


def _request(prompt: str) -> str:
    """The whole prompt but for a passage that a question is asked about."""
    m = _PASSAGE.search(prompt)
    return prompt[: m.start(1)] + "\n" + m[2] if m else prompt


def _lacks_answer(prompt: str) -> bool:
    """Whether a passage was given that does not hold what the question asks about."""
    m = _PASSAGE.search(prompt)
    if not m:
        return False
    passage = {w[:5] for w in words_of(m[1])}
    asked = [w for w in words_of(m[2]) if w not in _FUNCTION and len(w) > 3]
    if not asked:
        return False
    return sum(w[:5] in passage for w in asked) < 0.75 * len(asked)


# ---------------------------------------------------------------- copy


def _units(prompt: str) -> list[list[str]]:
    """What a copy may repeat: the whole prompt, its questions, its instruction."""
    parts = [p.strip() for p in re.split(r"\n+", prompt) if p.strip()]
    units = [words_of(prompt)]
    if len(parts) == 1:
        head = re.match(r"^([^.!?:]{3,70}):\s", prompt)
        if head and _REWORK.match(head[1]):  # what follows is material, not the request
            texts = [head[1]]
        else:
            texts = [*([head[1], prompt[head.end() :]] if head else []), *_SENTENCE.findall(prompt)]
    else:
        texts = []
        for p in parts:
            m = re.match(r"(?i)(question|instruction|task|request)\s*:\s*(.+)", p)
            if m:
                texts.append(m[2])
            elif p.endswith("?") or (_IMPERATIVE.match(p) and len(p) < 160):
                texts += _SENTENCE.findall(p) if len(p) > 160 else [p]
    for t in texts:
        w = words_of(t)
        if len(w) >= 3:
            units.append(w)
    return units


def is_copy(prompt: str, reply: str, p: list[str] | None = None, r: list[str] | None = None) -> bool:
    """The reply repeats the prompt, its question or instruction, and adds no answer."""
    p = words_of(prompt) if p is None else p
    r = words_of(reply) if r is None else r
    if len(r) < 3 or len(p) < 3 or len(r) > 2.3 * len(p) + MAX_LEAD:
        return False
    own = set(p)
    if sum(w in own for w in r) < 0.6 * len(r):
        return False
    grams = set(zip(p, p[1:]))
    inside = sum(g in grams for g in zip(r, r[1:]))
    if inside < 0.5 * (len(r) - 1):
        return False
    halves = [r]
    for lead in range(0, min(MAX_LEAD, len(r) - 4) + 1):  # the same words said twice
        rest = r[lead:]
        if len(rest) % 2 == 0 and rest[: len(rest) // 2] == rest[len(rest) // 2 :]:
            halves.append(r[:lead] + rest[: len(rest) // 2])
            break
    for unit in _units(prompt):
        for words in halves:
            if not len(unit) * 0.85 <= len(words) <= len(unit) + MAX_LEAD + 1:
                continue
            opening = unit[:5]  # else only what the prompt is about is given back
            if lcs(opening, words[: len(opening) + MAX_LEAD]) < 0.7 * len(opening):
                continue
            if lcs(unit, words) >= 0.9 * len(unit) and lcs(unit, words[-len(unit) - 1 :]) >= 0.88 * len(unit):
                return True
    return False


# ---------------------------------------------------------------- language


def language_of(words: list[str]) -> tuple[str | None, float, float]:
    """(language, its weight, weight of the second) by function words."""
    score: dict[str, float] = {}
    for w in words:
        for lang, weight in _LANG.get(w, ()):
            score[lang] = score.get(lang, 0.0) + weight
    if not score:
        return None, 0.0, 0.0
    order = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    return order[0][0], order[0][1], order[1][1] if len(order) > 1 else 0.0


def is_other_language(prompt: str, reply: str, p: list[str] | None = None, r: list[str] | None = None) -> bool:
    """But for a lead-in the reply is in another language than the prompt, unasked."""
    if is_code(reply):
        return False
    r, p = words_of(reply) if r is None else r, words_of(prompt) if p is None else p
    if len(r) < 4 or len(p) < 4:
        return False
    mine, weight, second = language_of(r)
    asked, own, other = language_of(p)
    if mine is None or asked is None or mine == asked:
        return False
    if weight < 1.2 or weight < 1.5 * second or own < 1.5 * other or weight < 0.09 * len(r):
        return False
    return not _TRANSLATE.search(prompt)


# ---------------------------------------------------------------- records


def defects(prompt: str, reply: str | None, model: Boundaries | None, asks: list | None = None) -> list[str]:
    """All defects of one reply to its prompt; without a model what the counts must say is put to ``asks``."""
    r = words_of(reply or "")
    if is_empty(reply, r):
        return ["empty"]
    p = words_of(prompt)
    out = []
    if is_copy(prompt, reply, p, r):
        out.append("copy")
    elif model is not None:
        if is_truncated(reply, model, p):
            out.append("truncated")
    elif (cut := ending(reply, p)) is True:
        out.append("truncated")
    elif cut:
        asks.append(cut)
    if is_refusal(prompt, reply, r):
        out.append("refusal")
    if is_other_language(prompt, reply, p, r):
        out.append("language")
    return out


def conversation_defects(stored: str | None, model: Boundaries | None, asks: list | None = None) -> set[str]:
    state, turns = parse(stored)
    if state == "cut":
        return {"truncated"}
    if state == "none":
        return {"empty"}
    found: set[str] = set()
    prompt, answered = "", False
    for role, text in turns:
        if role == "assistant":
            found.update(defects(prompt, text, model, asks))
            answered = True
        elif role == "user":
            prompt, answered = text or "", False
    if not answered:
        found.add("empty")
    return found


class Replies:
    """The replies of both tables, over which the contexts are counted."""

    def __init__(self, sft: DataFrame, dpo: DataFrame):
        self.sft, self.dpo = sft, dpo

    def counts(self, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """``(key, seen, ends)`` of the contexts that the sieve holds, ``(word, n)`` of all words."""
        shared = self.sft.sparkSession.sparkContext.broadcast(bits)
        fields = "key bigint, word string, seen bigint, ends bigint"
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())

        def tallied(batches, texts):
            tally = Tally(shared.value)
            for b in batches:
                tally.add(texts(b))
                if len(tally.words) > 300_000:
                    yield words(tally)
            key, seen, ends = tally.gathered()
            for lo in range(0, len(key), 100_000):
                k = key[lo : lo + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.string()), pa.array(seen[lo : lo + 100_000]), pa.array(ends[lo : lo + 100_000])], names=["key", "word", "seen", "ends"])
            yield words(tally)

        def words(tally):
            own, tally.words = tally.words, Counter()
            cols = ([None] * len(own), list(own), list(own.values()), [0] * len(own))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "word", "seen", "ends"])

        def of_conversations(b):
            return [text for m in b.column(0).to_pylist() for role, text in parse(m)[1] if role == "assistant" and text]

        def of_pairs(b):
            return [text for k in range(2) for text in b.column(k).to_pylist() if text]

        a = self.sft.select(F.col("messages").cast("string")).mapInArrow(lambda batches: tallied(batches, of_conversations), fields)
        b = self.dpo.select(*[F.col(c).cast("string") for c in ("chosen", "rejected")]).mapInArrow(lambda batches: tallied(batches, of_pairs), fields)
        both = a.unionByName(b).groupBy("key", "word").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
        folder = f"{shared_folder(self.sft.sparkSession)}/pairs-{uuid.uuid4().hex}/counts"
        least = F.when(F.col("key").isNull(), VOCABULARY).otherwise(SOME)
        both.where(F.col("seen") >= least).write.parquet(folder)
        both = self.sft.sparkSession.read.schema(both.schema).parquet(folder)
        return both.where("key is not null").drop("word"), both.where("word is not null").select("word", F.col("seen").alias("n"))


def fit(sft: DataFrame, dpo: DataFrame) -> Replies:
    """The contexts of all replies of both tables; they are counted once it is known which are asked about."""
    return Replies(sft, dpo)


def build_sieve(keys: DataFrame) -> np.ndarray:
    """Bits of the keys of a table, by their upper bits; 16 bits a key but SIFT_BITS at most."""
    least, most = SIFT_BITS
    bits = min(most, max(least, 1 << (16 * keys.count()).bit_length()))
    place = F.shiftrightunsigned("key", 64 - (bits - 1).bit_length())
    words = keys.select(F.shiftright(place, 5).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - (bits - 1).bit_length()}) & 31 as int))").alias("word"))
    table = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most SIFT_BITS / 32 rows
    out = np.zeros(bits // 32, np.uint32)
    out[table.column("at").to_numpy()] = table.column("word").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _answered(asked: DataFrame, replies: Replies) -> DataFrame:
    """``(row_id, field)`` of the replies that ask and are cut, by the counts of all replies."""
    contexts = asked.select("keys").distinct()
    sieve = build_sieve(contexts.select(F.explode("keys").alias("key")).distinct())
    counts, words = replies.counts(sieve)
    enough = F.element_at(F.array(*[F.lit(k) for k in ENOUGH]), F.col("level") + 1)
    each = contexts.select("keys", F.posexplode("keys").alias("level", "key")).join(counts, "key").where((F.col("seen") >= enough) | (2 * F.col("ends") >= F.col("seen")))
    rare = each.groupBy("keys").agg(F.min_by(F.col("ends") / F.col("seen"), "level").alias("share")).where(F.col("share") < RARELY).select("keys")
    tails = asked.where("tail is not null").select("tail").distinct()
    vocabulary = words.select(F.lower("word").alias("word")).distinct()
    parts = vocabulary.select("word", F.explode(F.sequence(F.lit(2), F.length("word"))).alias("n")).where("length(word) > 1").select(F.expr("substring(word, 1, n)").alias("tail"), (F.col("n") == F.length("word")).alias("whole"))
    known = parts.join(tails, "tail", "left_semi").groupBy("tail").agg(F.bool_or(~F.col("whole")).alias("stem"), F.bool_or("whole").alias("whole")).where("stem").drop("stem")
    broken = asked.join(known, "tail").where("foreign or not whole")
    return broken.select("row_id", "field").unionByName(asked.join(rare, "keys", "left_semi").select("row_id", "field"))


_models: dict[str, Boundaries] = {}


def found(sft: DataFrame, dpo: DataFrame, model: Boundaries | Replies) -> DataFrame:
    """``(row_id, field, defect)`` of every defective reply of both tables; one narrow pass over each, and one to count."""
    if isinstance(model, Boundaries):
        return _judged(sft, dpo, model).where("defect is not null").select("row_id", "field", "defect").distinct()
    spark = sft.sparkSession
    judged = _judged(sft, dpo, None)
    folder = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}/judged"
    judged.write.parquet(folder)
    judged = spark.read.schema(judged.schema).parquet(folder)
    cut = _answered(judged.where("defect is null").drop("defect"), model).select("row_id", "field", F.lit("truncated").alias("defect"))
    return judged.where("defect is not null").select("row_id", "field", "defect").unionByName(cut).distinct()


def _judged(sft: DataFrame, dpo: DataFrame, model: Boundaries | None) -> DataFrame:
    """Rows of ASKED_SCHEMA: the defects that are settled, and, with no defect, what the counts must say of the others."""
    shared = model and sft.sparkSession.sparkContext.broadcast((model.seen, model.ends, model.vocabulary))
    key = uuid.uuid4().hex

    def load() -> Boundaries | None:
        if shared is None:
            return None
        if key not in _models:
            _models.clear()
            own = Boundaries()
            own.seen, own.ends, own.vocabulary = shared.value
            own.stems = {w[:k] for w in own.vocabulary for k in range(2, len(w))}
            _models[key] = own
        return _models[key]

    def emit(rows):
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row_id", "field", "defect", "tail", "foreign", "keys"])

    def rows_of(i, field, defects, asks):
        return [(i, field, d, None, None, None) for d in sorted(defects)] + [(i, field, None, tail, foreign, context_keys(tags)) for tail, foreign, tags in asks]

    def conversations(batches):
        own = load()
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                asks: list = []
                rows += rows_of(i, "messages", conversation_defects(m, own, asks), asks)
            yield emit(rows)

    def replies(batches):
        own = load()
        for b in batches:
            rows = []
            for i, p, *both in zip(*(b.column(k).to_pylist() for k in range(4))):
                state, turns = parse(p)
                asked = next((t or "" for role, t in reversed(turns) if role == "user"), "") if state != "none" else ""
                if state == "cut":
                    asked = ""
                for field, text in zip(("chosen", "rejected"), both):
                    asks: list = []
                    rows += rows_of(i, field, defects(asked, text, own, asks), asks)
            yield emit(rows)

    a = sft.select(F.col("row_id").cast("bigint"), F.col("messages").cast("string")).mapInArrow(conversations, ASKED_SCHEMA)
    b = dpo.select(F.col("row_id").cast("bigint"), *[F.col(c).cast("string") for c in ("prompt", "chosen", "rejected")]).mapInArrow(replies, ASKED_SCHEMA)
    return a.unionByName(b)
