"""Defective responses of prompt and response pairs: empty, refusal, copy, wrong language, truncated.

Languages: naive Bayes over character n-grams gives posteriors of languages to the prompt and to stretches of the response; where
they hardly agree the response speaks another language. Texts that say too little have no defect of this kind.
Truncation: n-grams of sentence ends, counted in all distinct prompts, say how likely a sentence ends after its last words; a
logistic model takes this likelihood, and how far the sentence goes along the prompt's sentence that it renders. It is fitted on all
responses that end as sentences do, whole and cut by us; what a response's own prompt adds to the counts is taken off for it.
Refusals: a softmax over words and word pairs of sentences, fitted on sentences made up here and on all sentences of all prompts.
Nothing is sampled: counts are added up in buckets of hashes, gradients and Newton steps in passes over stored features.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stylomill.session import materialize

# Labelled seed texts of the language classifier, written for this purpose.
SEEDS = {
    "en": "the people of this town have waited for a long time and they would like to know what will happen next when the council meets again in the morning she said that nothing was certain but the work should be finished before winter although there were still some questions about who pays for it and why it costs so much many of them had been told that their houses were not at risk which was true until last week he does not think that we can do this without help from other cities because our own money is gone honestly this is the first year with great weather while those who left earlier were glad to see how quickly things moved on",
    "es": "la gente de esta ciudad ha esperado mucho tiempo y quiere saber qué pasará cuando el consejo se reúna otra vez por la mañana ella dijo que nada era seguro pero que el trabajo debería terminar antes del invierno aunque todavía hay preguntas sobre quién lo paga y por qué cuesta tanto muchos de ellos creían que sus casas no corrían peligro lo cual era cierto hasta la semana pasada él no cree que podamos hacerlo sin ayuda de otras ciudades porque nuestro dinero se ha acabado los vecinos han ganado el partido una plaza muestra siempre un pequeño mercado nuestra calle busca hoy otro puerto entre el río y la escuela también casi nunca nadie está aquí según dicen",
    "fr": "les gens de cette ville ont attendu longtemps et ils voudraient savoir ce qui va se passer quand le conseil se réunira de nouveau demain matin elle a dit que rien n'était sûr mais que le travail devrait être terminé avant l'hiver bien qu'il y ait encore des questions sur ceux qui paient et pourquoi cela coûte si cher beaucoup d'entre eux croyaient que leurs maisons ne risquaient rien ce qui était vrai jusqu'à la semaine dernière il ne pense pas que nous puissions le faire sans l'aide des autres villes parce que notre argent est parti une équipe cherche encore un nouveau pont dans la rue malgré le juge cette récolte reste toujours très petite aujourd'hui chez nous aussi presque jamais perdu",
    "de": "die Leute in dieser Stadt haben lange gewartet und möchten wissen was geschieht wenn der Rat am Morgen wieder zusammenkommt sie sagte dass nichts sicher sei aber die Arbeit sollte vor dem Winter fertig werden obwohl es noch Fragen gibt wer das bezahlt und warum es so viel kostet viele von ihnen glaubten dass ihre Häuser nicht in Gefahr wären was bis zur letzten Woche auch stimmte er denkt nicht dass wir das ohne Hilfe aus anderen Städten schaffen weil unser eigenes Geld weg ist eine Straße bleibt heute zwischen kleinen Brücken offen das Urteil wurde gestern durch die Behörde verkauft jede Mannschaft sucht plötzlich einen neuen Vertrag gegen den alten Markt über keine Schule nach ihm wurde",
    "it": "la gente di questa città ha aspettato a lungo e vorrebbe sapere che cosa succederà quando il consiglio si riunirà di nuovo domani mattina lei ha detto che niente era sicuro ma il lavoro dovrebbe essere finito prima dell'inverno anche se ci sono ancora domande su chi paga e perché costa così tanto molti di loro credevano che le loro case non fossero in pericolo il che era vero fino alla settimana scorsa egli non pensa che possiamo farlo senza l'aiuto di altre città perché i nostri soldi sono finiti della nella gli degli più questo quella",
    "pt": "as pessoas desta cidade esperaram muito tempo e gostariam de saber o que vai acontecer quando o conselho se reunir outra vez de manhã ela disse que nada era certo mas o trabalho deveria terminar antes do inverno embora ainda haja perguntas sobre quem paga e por que custa tanto muitos deles acreditavam que as suas casas não corriam perigo o que era verdade até à semana passada ele não acha que possamos fazê-lo sem a ajuda de outras cidades porque o nosso dinheiro acabou uma decisão da região também não são então",
    "nl": "de mensen in deze stad hebben lang gewacht en willen weten wat er gebeurt als de raad morgen weer bij elkaar komt zij zei dat niets zeker was maar dat het werk voor de winter klaar moet zijn hoewel er nog vragen zijn over wie het betaalt en waarom het zoveel kost velen van hen dachten dat hun huizen geen gevaar liepen wat tot vorige week ook waar was hij denkt niet dat wij dit zonder hulp van andere steden kunnen omdat ons eigen geld op is een van het met voor naar door ook niet zijn",
    "ru": "люди этого города долго ждали и хотят знать что будет когда совет снова соберётся утром она сказала что ничего не ясно но работа должна закончиться до зимы хотя ещё есть вопросы кто за это платит и почему это стоит так дорого многие из них думали что их домам ничего не грозит и это было правдой до прошлой недели он не думает что мы сможем это сделать без помощи других городов потому что наши деньги кончились каждая школа снова показала новый мост вчера эта газета нашла местный урожай через старую площадь против суда",
}
_LANGS = list(SEEDS)
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_UNSEEN = re.compile("[­​-‏⁠﻿️]")

# Headings a response may carry before the text itself.
_HEADING = re.compile(r"^\s*(?:(?:sure|certainly|of course)[,!.]?\s*)?(?:here(?:'s| is| are)\b[^:\n]{0,60}|(?:the )?(?:re)?(?:written|phrased|worded) ?(?:text|version)?|(?:new |final )?(?:text|output|response|answer|version|result))\s*:\s*", re.I)
_QUOTED = re.compile(r"“[^”]*”|\"[^\"]*\"|«[^»]*»|‘[^’]{12,}’(?=\W)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”'’)\]]*\s+|\n+")
#: Share of words and word pairs in common from which a response is a copy.
COPY = 0.85
#: Words besides refusing and polite sentences up to which a text with a refusal is one.
FEW_WORDS = 20


#: Words that must be there to tell a language, and the least share of the likeliest language that tells one.
LEAST_WORDS, SURE = 3, 0.9
#: Posteriors of prompt and stretch that agree less than this speak different languages.
AGREE = 0.05


class _Made(dict):
    """What a function makes of each key, kept for those met."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        v = self[key] = self.make(key)
        return v


class Languages:
    """Naive Bayes over character 1- to 4-grams of words; log-likelihoods per language are kept for each word met."""

    def __init__(self, seeds: dict[str, str] = SEEDS, smooth: float = 0.3, most: int = 200_000):
        counts = [Counter(g for w in _LETTERS.findall(t.lower()) for g in self.grams(w)) for t in seeds.values()]
        every = set().union(*counts)
        self.table = {}
        total = [sum(c.values()) + smooth * (len(every) + 1) for c in counts]
        for g in every:
            self.table[g] = np.log([(c[g] + smooth) / t for c, t in zip(counts, total)])
        self.unseen = np.log([smooth / t for t in total])
        self.most, self.words, self.rows = most, _Made(self.row), np.zeros((1 << 12, len(seeds)))

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]

    def row(self, w: str) -> int:
        """Puts the log-likelihoods of a word into the next row of the matrix of those met."""
        v, k = np.sum([self.table.get(g, self.unseen) for g in self.grams(w)], axis=0), len(self.words)
        if k == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = v - v.max()
        return k

    def scores(self, text: str) -> np.ndarray:
        """A row of log-likelihoods for each word."""
        if len(self.words) > self.most:
            self.words.clear()
        at = list(map(self.words.__getitem__, _LETTERS.findall(text.lower())))  # before the matrix is read: it may grow
        return self.rows[np.array(at, np.intp)]

    @staticmethod
    def _posterior(s: np.ndarray) -> np.ndarray:
        p = np.exp(s - s.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    def posterior(self, text: str) -> np.ndarray:
        """Share of each language, even before a word is seen."""
        return self._posterior(np.clip(self.scores(text), -12, 0).sum(0))

    def disagreement(self, prompt: str, response: str, width: int = 7) -> float:
        """Share of the response's words in stretches whose posterior hardly agrees with the prompt's; 0 if either says too little."""
        asked, s = np.clip(self.scores(prompt), -12, 0), np.clip(self.scores(response), -12, 0)
        if min(len(asked), len(s)) < LEAST_WORDS:
            return 0.0
        asked = self._posterior(asked.sum(0))
        if asked.max() < SURE or self._posterior(s.sum(0)).max() < SURE:
            return 0.0
        run = np.cumsum(np.vstack([np.zeros(len(_LANGS)), s]), axis=0)
        half, at = width // 2, np.arange(len(s))
        near = run[np.minimum(at + half + 1, len(s))] - run[np.maximum(at - half, 0)]
        return float((self._posterior(near) @ asked < AGREE).mean())


# Sentences of the labelled table of refusals, made up here: each part of a row is joined with each of the next.
_BEGIN = "|I'm sorry, but |Sorry, |Unfortunately, |I am afraid |Apologies, |My apologies, but |As a language model, |As an AI, |As an assistant, |Regrettably, |Thank you for asking, but |I appreciate it, but ".split("|")
_REFUSE = "I cannot|I can't|we cannot|I could not|I won't|I will not|we will not|I am unable to|I'm unable to|I'm not able to|I must decline to|I have to decline to|I decline to|I refuse to|I'm not allowed to|I am not permitted to|I'd rather not|I prefer not to|I do not feel able to|it is not possible for me to|I have decided not to|I need to decline to".split("|")
_WHAT = "help|help with that|help with this|assist with this request|do that|do this|complete this task|fulfil this request|answer that|rewrite this|rewrite the text|write this|write such a text|provide a rewrite|provide that|produce such content|continue|continue with this|comply|process this text|create this|generate that text|paraphrase this passage|respond to this|take this on|offer a version".split("|")
REFUSALS = """
I have to turn this one down|I must turn that down|That is one I will turn down|I will pass on this|I have to pass on that one|I'll have to pass|Let me pass on this request|I'm not comfortable writing this|I am not comfortable with that|This is not something I feel comfortable with|This isn't something I can do
That's not something I am able to write|Request denied|Your request was declined|This request has been refused|Request refused|The request cannot be fulfilled|Task declined|Declined|No rewrite can be provided|No answer will be given|No version can be offered|No text could be produced
It would go against my guidelines|This goes against our policy|That violates my rules|My guidelines do not allow this|My instructions don't permit that|This falls outside what I may do|That lies beyond what I am allowed to do|It would not be appropriate for me to continue|It would not be right for me to write it
I'm going to decline|I respectfully decline|I decline|I refuse|I can't|I cannot|I won't do it|I won't|I will not be doing that|I'd rather not|I would rather not do this|I'm unable to|Not something I will do|I choose not to answer|I must say no|The answer is no|I have to say no to this
As a language model I do not write such texts|As an AI I don't have the ability to do this|I do not have permission to rewrite it|I lack the ability to do that|I don't think I can help here|There is nothing I can do with this text|I am only an assistant and can't do this|You will have to ask someone else to write it
""".replace("\n", "|").strip("|").split("|")
COURTESY = """
Please provide another text|Please try a different request|Please give me something else|Is there anything else I can do for you|Is there something else you need|Let me know if you need anything else|Let me know how else I can help|I'd be happy to help with something else|I would gladly look at another passage
Thank you for understanding|Thanks for your patience|Feel free to ask another question|Perhaps I can help with something different|I can offer a summary instead|I can help with another text if you like|Sorry about that|Apologies for the inconvenience|I apologise|I'm sorry|Unfortunately not|I hope you understand
Please send me a new text|Could you share a different passage|What else may I do for you|I am happy to try another one|Thanks|Thank you|Sorry|My apologies|Please let me know
""".replace("\n", "|").strip("|").split("|")
ORDINARY = """
I cannot believe how cold it is|I can't wait for the weekend|We can't afford the rent any more|I will not forget that evening|We will not leave this valley|I won't be at the market on Monday|They won't sell the mill|She said that she could not help him|He could not find his keys|I could not sleep at all
The council refused the request|The judge denied the request on Friday|Her request was turned down by the bank|He declined to comment|The mayor declined to answer questions|Nobody was able to open the door|We were unable to reach the owner|I was unable to see the stage|The driver was not allowed to park there
I'm sorry for your loss, said the nurse|Sorry we are late|Unfortunately the train was full|Unfortunately it rained all day|I am afraid of dogs|I am afraid the shop has closed|My apologies to everyone who came|I have to go to work|I must say the soup was good|I have to turn left at the church|I pass this house each day
The new policy goes against the old rules|These guidelines do not help farmers|Our rules allow two dogs|The text of the contract was printed twice|He wrote a book about the harbour|She will write to the minister|They continue to rebuild the pier|I do not think so|I don't know who did it|There is nothing in the box|No answer came from the office
Please close the gate|Please bring a coat and a cup|Thank you all for coming to the hall|Thanks to the baker for the bread|Let me know when you are back, he told her|Is there anything left of the cake|The assistant closed the shop|A language teacher lives next door|The model of the ship was sold|Any text will do|It says so on the door
The people of this town waited for a long time|Work on the road should be finished before winter|Several families saw the water rise|The owner of the farm sold two cows|A boy found a coin under the bridge|The choir sang until midnight|Prices rose again in spring|He plays the piano in the evening|The old clock stopped at noon|Whatever it costs
""".replace("\n", "|").strip("|").split("|")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|\d+")


class _Hashes(dict):
    """64-bit hashes of words, kept for those met."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_HASHES = _Hashes()


def _mixed(kind: int, *words: np.ndarray) -> np.ndarray:
    h = np.full(len(words[0]), kind * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
    return h


@lru_cache(1)
def labelled(seed: int = 5) -> list[tuple[str, int]]:
    """The sentences made here: 0 refusal, 1 courtesy, 2 another sentence."""
    g = np.random.default_rng(seed)
    made = [f"{_BEGIN[a]}{_REFUSE[b]} {_WHAT[c]}" for a, b, c in zip(*(g.integers(0, len(x), 1500) for x in (_BEGIN, _REFUSE, _WHAT)))]
    made += [f"{b}{r[0].lower() + r[1:]}" for r in REFUSALS for b in ("", "", "Sorry, ", "I'm afraid ", "Unfortunately, ")] * 3
    return [(x, 0) for x in made] + [(x, 1) for x in COURTESY * 12] + [(x, 2) for x in ORDINARY * 10]


def _spoken(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, word pairs and pairs of next but one words of all sentences, and which sentence each is in."""
    words, size = [], []
    for s in sentences:
        w = _PLAIN_WORD.findall(s.lower().replace("’", "'"))
        words += ["<", *w, ">"]
        size.append(len(w) + 2)
    h = np.fromiter((_HASHES[w] for w in words), np.uint64, len(words))
    of = np.repeat(np.arange(len(size)), size)
    one = np.flatnonzero((h != np.uint64(_HASHES["<"])) & (h != np.uint64(_HASHES[">"])))
    two, three = (np.flatnonzero(of[:-k] == of[k:]) for k in (1, 2))
    return np.concatenate([_mixed(11, h[one]), _mixed(12, h[two], h[two + 1]), _mixed(13, h[three], h[three + 2])]), np.concatenate([of[one], of[two], of[three]])


@lru_cache(1)
def _features_made() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what the sentences made here say, in order, and the marks of their first bits."""
    keys, marks = np.unique(_spoken([x for x, _ in labelled()])[0]), np.zeros(1 << 20, bool)
    marks[keys >> np.uint64(44)] = True
    return keys, marks


class Refusals:
    """Softmax over the words and word pairs of a sentence: refusal, courtesy, or any other sentence.

    Features are those of the sentences made here, a slot for each; what they don't say is no evidence. Slot 0, which weighs
    nothing, is in every sentence.
    """

    SLOTS = 1 << 12
    BIAS = np.array([-1.0, -1.0, 0.0])  # what says nothing is no refusal

    def __init__(self, others: list[str] | tuple[int, Callable[[np.ndarray], np.ndarray]], epochs: int = 30, rate: float = 0.25, decay: float = 1e-5):
        """others: ordinary sentences, or how many there are and what gives the sum of their gradients at given weights."""
        rows = labelled()
        flat, size = self.packed([x for x, _ in rows])
        y = np.array([k for _, k in rows])
        if isinstance(others, list):
            theirs = self.packed(others)
            others = len(others), lambda w: self.gradient(w, *theirs)
        n = len(rows) + others[0]
        share = n / (3 * (np.bincount(y, minlength=3) + [0, 0, others[0]]).clip(1))
        self.w = np.zeros((self.SLOTS, 3))
        m = np.zeros_like(self.w)
        for _ in range(epochs):  # full gradients, scaled by what each feature has seen (Adagrad)
            grad = self.gradient(self.w, flat, size, y, share) - decay * n * self.w
            if others[0]:
                grad += share[2] * others[1](self.w)
            m += grad * grad
            self.w += rate * grad / (np.sqrt(m) + 1e-6)

    @classmethod
    def packed(cls, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all sentences in one array, and how many each has."""
        keys, of = _spoken(sentences)
        made, marks = _features_made()
        some = np.flatnonzero(marks[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(made, keys[some]), len(made) - 1)
        there = made[at] == keys[some]
        both = np.sort(np.concatenate([np.arange(len(sentences)) * cls.SLOTS, of[some[there]] * cls.SLOTS + 1 + at[there]]))
        both = both[np.diff(both, prepend=-1) > 0]
        return (both % cls.SLOTS).astype(np.uint16), np.bincount(both // cls.SLOTS, minlength=len(sentences)).astype(np.uint32)

    @classmethod
    def gradient(cls, w: np.ndarray, flat: np.ndarray, size: np.ndarray, y: np.ndarray | None = None, share: np.ndarray | None = None) -> np.ndarray:
        """Of the log-likelihood at w: sentences of the classes y (2, if not given), weighted by the class's share."""
        total, start, first = np.zeros((cls.SLOTS, 2)), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
        above = [np.ascontiguousarray(w[:, k] - w[:, 2]) for k in (0, 1)]  # against the class of other sentences
        while first < len(size):
            end = max(first + 1, int(np.searchsorted(start, start[first] + 500_000)) - 1)
            f, n, at = flat[start[first] : start[end]].astype(np.intp), size[first:end], start[first:end] - start[first]
            s = [np.clip(np.add.reduceat(above[k][f], at) + cls.BIAS[k], -500, 500) for k in (0, 1)]
            e = [np.exp(x) for x in s]
            for k in (0, 1):
                d = -e[k] / (1 + e[0] + e[1])
                if y is not None:
                    d += y[first:end] == k
                    d *= share[y[first:end]]
                total[:, k] += np.bincount(f, np.repeat(d, n), cls.SLOTS)
            first = end
        total[0] = 0
        return np.column_stack([total, -total.sum(1)])  # shares add up to 1

    def kinds(self, sentences: list[str]) -> np.ndarray:
        """0 refusal, 1 courtesy, 2 another sentence."""
        flat, size = self.packed(sentences)
        return (np.add.reduceat(self.w[flat], np.cumsum(size, dtype=np.int64) - size, axis=0) + self.BIAS).argmax(1)

    def __call__(self, text: str) -> bool:
        return self.declines([text])[0]

    def declines(self, texts: list[str]) -> list[bool]:
        """Whether each text declines: a refusing sentence outside quotations, few words besides it and polite ones."""
        bare = [_SENTENCE.split(_QUOTED.sub(" “” ", _body(t))) for t in texts]
        declined, other, active, at = [False] * len(texts), [0] * len(texts), list(range(len(texts))), 0
        while active:  # three sentences of each text at a time, until it says enough else
            asked = [(i, x) for i in active for x in bare[i][at : at + 3]]
            for (i, x), kind in zip(asked, self.kinds([x for _, x in asked]).tolist()):
                n = len(_WORD.findall(x)) if other[i] <= FEW_WORDS else 0
                if n and kind == 0:
                    declined[i] = True
                elif kind == 2:
                    other[i] += n
            at += 3
            active = [i for i in active if other[i] <= FEW_WORDS and len(bare[i]) > at]
        return [d and n <= FEW_WORDS for d, n in zip(declined, other)]


_WHOLE = re.compile(r"[.!?][\"”'’)\]]*$")


#: Words before the last one that contexts of each kind hold, the last one being 0; kind 0 is the word as such, however its sentence ends.
CONTEXTS = ((0,), (0,), (1, 0), (2, 1), (2, 1, 0), (3, 2, 1))


def occurrences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Hashes of the contexts at each word, which text each is in, whether a sentence ends there; words and sentence ends counted."""
    words, size, of = [], [], []
    for k, t in enumerate(texts):
        for s in _SENTENCE.split(t):
            w = _WORD.findall(s.lower())
            if w:
                words += w
                size.append(len(w))
                of.append(k)
    h = np.fromiter((_HASHES[w] for w in words), np.uint64, len(words))
    size, of = np.array(size, np.int64), np.repeat(np.array(of, np.int64), size)
    at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    last = at == np.repeat(size, size) - 1  # prompts are whole: lines without a full stop end there too
    keys, where, ended = [_mixed(0, h)], [of], [np.zeros(len(h), bool)]
    for kind, back in enumerate(CONTEXTS[1:], 1):
        i = np.flatnonzero(at >= max(back))
        keys.append(_mixed(kind, *(h[i - k] for k in back)))
        where.append(of[i])
        ended.append(last[i])
    return np.concatenate(keys), np.concatenate(where), np.concatenate(ended), (len(h), int(last.sum()))


def added_up(keys: np.ndarray, seen: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of what is counted for each."""
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(seen[order].astype(np.int64), start), np.add.reduceat(ended[order].astype(np.int64), start)


def looked_up(wanted: np.ndarray, keys: np.ndarray, seen: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is counted for each wanted key; 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return seen[at] * there, ended[at] * there


def base_rate(words: int, ends: int, smooth: float = 0.5) -> float:
    return (ends + smooth) / (words + 2 * smooth + 1e-9)


def end_scores(seen: np.ndarray, ended: np.ndarray, base: float, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """How likely a sentence ends after given words: the mean of its contexts' log-odds against the mean rate, the most telling
    counting by what was seen of them, and the lowest of those that hold the last word. 0 knows nothing; what was seen once is no evidence."""
    p = (ended + smooth * base * 2) / (seen + 2 * smooth)
    k = np.log1p(seen) * (seen >= 2)
    odds = np.log(np.maximum(p, 1e-4) / np.maximum(1 - p, 1e-4) * (1 - base) / base)
    mean = (k * odds).sum(1) / np.maximum(k.sum(1), 1e-9)
    odds = np.log(np.maximum(p, 1e-6) / np.maximum(1 - p, 1e-4) * (1 - base) / base)  # of a whole table's counts, less can be told
    last = np.where(seen >= 2, odds, np.inf)[:, [0, 1, 3]].min(1)
    return mean, np.where(np.isinf(last), 0, last)


class SentenceEnds:
    """Counts of the contexts of texts that are at hand."""

    def __init__(self, texts: list[str]):
        keys, _, ended, (words, ends) = occurrences(texts)
        self.counts = added_up(keys, np.ones(len(keys)), ended)
        self.base, self.texts = base_rate(words, ends), set(texts)


_TAIL_TAG = re.compile(r"(?:\s*(?:</?\w+>|&\w+;(?: more)?))+\s*$")
_EXTRA = r"(?:https?://\S+|www\.\S+|#\w+|[\U0001F000-\U0001FAFF☀-➿‍️⬀-⯿]+)"
_TAIL_EXTRA, _AN_EXTRA = re.compile(rf"(?:\s*{_EXTRA})+\s*$"), re.compile(_EXTRA)
_QUOTE_CLOSED = re.compile(r",[”\"]\s*$")
_PIECE = re.compile(r"(?<=[.!?…])[\"”'’)\]]*\s+|\n+|(?<=,[”\"])\s+")
_CLOSERS = "\"”'’)]»*_` \t\n\r\x0b\x0c "


_INNER = re.compile("[“”\"]")


@lru_cache(64)
def _body(text: str) -> str:
    """A text without what is decoration: invisible signs, heading, quotation marks around all of it."""
    t = (text if text.isascii() else _UNSEEN.sub("", text)).strip()
    heading = _HEADING.match(t)
    t = t[heading.end() :].strip() if heading else t
    if len(t) > 1 and t[0] in "\"“" and t[-1] in "\"”" and not _INNER.search(t[1:-1]):
        t = t[1:-1].strip()
    return t


def _without_tags(text: str) -> str:
    return _TAIL_TAG.sub("", text) if text.rstrip().endswith((">", ";", "more")) else text


def _extra(text: str) -> re.Match | None:
    """Links, hash tags and pictures at the end; none where the last word holds none."""
    last = text.rsplit(None, 1)[-1:]
    return _TAIL_EXTRA.search(text) if last and _AN_EXTRA.search(last[0]) else None


def copied_share(prompt: list[str], response: list[str], least: float = 0.0) -> float:
    """Words that both have, as a share of the longer text, the mean with that of word pairs; 0 where it can't be as much as `least`."""
    if not prompt or not response:
        return 0.0
    one = sum((Counter(prompt) & Counter(response)).values()) / max(len(prompt), len(response))
    if len(prompt) < 2 or len(response) < 2:
        return one
    if one + 1 < 2 * least:
        return 0.0
    pa, pb = Counter(zip(prompt, prompt[1:])), Counter(zip(response, response[1:]))
    return (one + sum((pa & pb).values()) / (max(len(prompt), len(response)) - 1)) / 2


def last_words(prompt: str, response: str) -> tuple[bool | None, str]:
    """Whether signs alone show how a response ends: broken off (True), finished (False), or not (None), and its last, open sentence."""
    t, p = _body(response), _body(prompt)
    tail = _without_tags(t).rstrip()
    extra = _extra(tail)
    if extra:  # a link or tag at the end shows that the end was reached, unless the prompt's goes on
        last = extra.group().split()[-1]
        have = _without_tags(p).split()
        return len(last) > 2 and last not in have and any(x.startswith(last) and x[len(last)].isalnum() for x in have if len(x) > len(last)), ""
    if _QUOTE_CLOSED.search(tail):  # a quotation whose speaker stands elsewhere, sentences having changed places
        return False, ""
    core = tail.rstrip(_CLOSERS)
    if re.search(r"(?:\.\.+|…)$", core):
        return not re.search(r"(?:\.\.+|…)[\"”'’)\]]*\s*$", p), ""
    if re.search(r"[.!?。]$", core):
        return False, ""
    return None, re.split(r"[.!?…][\"”'’)\]]*\s+|\n+", core)[-1]


FEATURES = ("one", "end", "end_low", "goes_on", "as_long", "longer", "unaligned", "alike", "comma", "cut", "prefix", "short", "lowest")


@lru_cache(8)
def _prompt_words(prompt: str) -> tuple[set[str], list[list[str]]]:
    """All words of a prompt, and those of its sentences of two words or more."""
    p = _body(prompt)
    tail = _without_tags(p)
    extra = _extra(tail)
    pieces = (_WORD.findall(s) for s in _PIECE.split((tail[: extra.start()] + tail[extra.end() :] if extra else tail).lower()))
    return set(_WORD.findall(p.lower())), [w for w in pieces if len(w) > 1]


def end_shape(prompt: str, words: list[str], last: str) -> list[float]:
    """What tells whether an open sentence is whole, but for the counts: cut and prefix are of last words that its prompt lacks.

    goes_on, as_long, longer: the prompt's sentence that is most like it has more words, as many, fewer; alike: how like.
    """
    f = words
    comma = bool(re.search(r"[,;:–—-]$", last))
    if not f:
        return [1, 0, 0, 0, 0, 0, 1, 0, comma, 0, 0, 1, 0]
    in_prompt, pieces = _prompt_words(prompt)
    known = f[-1] in in_prompt
    prefix = not known and any(x.startswith(f[-1]) and len(x) > len(f[-1]) for x in in_prompt)
    best, gap = 0.0, 0
    parts = [f[skip:] for skip in range(0, min(5, len(f)))]
    for w in pieces:
        for skip, g in enumerate(parts):
            same = sum(map(eq, g, w))
            if not same:  # nothing to be like
                continue
            m = same / min(len(g), len(w)) - 0.02 * skip
            # a full rendering ends with the words its model ends with
            if m > best + 1e-9 or (abs(m - best) < 1e-9 and m > 0 and abs(len(w) - len(g)) < abs(gap)):
                best, gap = m, len(w) - len(g)
    near = best >= 0.3
    return [1, 0, 0, near and gap > 0, near and gap == 0, near and gap < 0, not near, best, comma, not known, prefix, len(f) <= 3 and not (near and gap == 0), 0]


def end_examples(prompts: list[str], of: list[int], lasts: list[str], counted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of open sentences and the places of their prompts: shapes, contexts (0: there is none), and what is counted of them in their own prompts.

    counted: which of the prompts are among the counted texts (all, if not given).
    """
    words = [_WORD.findall(x.lower()) for x in lasts]
    n = len(lasts)
    shape = np.array([end_shape(prompts[k], w, x) for k, w, x in zip(of, words, lasts)], float).reshape(n, len(FEATURES))
    tail = np.zeros((4, n), np.uint64)
    for i, w in enumerate(words):
        for k, x in enumerate(reversed(w[-4:])):
            tail[k, i] = _HASHES[x]
    length = np.array([len(w) for w in words], int)
    contexts = np.stack([_mixed(kind, *(tail[k] for k in back)) * (length > max(back)) for kind, back in enumerate(CONTEXTS)], 1)
    keys, where, ended, _ = occurrences(prompts)
    if counted is not None:
        keys, where, ended = keys[counted[where]], where[counted[where]], ended[counted[where]]
    some = np.zeros(1 << 20, bool)
    some[contexts >> np.uint64(44)] = True
    some = some[keys >> np.uint64(44)]  # those wanted, and a few besides
    mine = added_up(_mixed(9, keys[some], where[some].astype(np.uint64)), np.ones(some.sum()), ended[some])
    asked = _mixed(9, contexts.ravel(), np.repeat(np.array(of, np.uint64), len(CONTEXTS)))
    seen, ends = looked_up(asked.reshape(contexts.shape), *mine)
    return {"shape": shape, "contexts": contexts, "own_seen": seen, "own_ends": ends}


def end_features(shape: np.ndarray, contexts: np.ndarray, own_seen: np.ndarray, own_ends: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray], base: float) -> np.ndarray:
    """Shapes with what the counts tell besides: their own prompts' share is taken off, as no prompt may speak for its own response."""
    seen, ended = looked_up(contexts, *counts)
    there = contexts != 0
    seen, ended = (seen - own_seen) * there, (ended - own_ends) * there
    score, lowest = end_scores(seen[:, 1:], ended[:, 1:], base)
    x = shape.copy()
    x[:, 1], x[:, 2], x[:, 12] = np.clip(score, -6, 6), score < -2.5, np.clip(lowest, -12, 6)
    x[:, 9] *= seen[:, 0] == 0  # a word of other prompts isn't cut
    return x


def known_ends(prompt: str, response: str) -> list[str]:
    """The last sentence of a response without its full stop, and the same cut by us, where it is sure that the response ends there."""
    t = _body(response).rstrip()
    if not t or not _WHOLE.search(t) or len(_WORD.findall(t)) < 8:
        return []  # how it ends must be known
    whole = t.rstrip(_CLOSERS).rstrip(".!?")
    last = re.split(r"[.!?…][\"”'’)\]]*\s+|\n+", whole)[-1]
    words = list(re.finditer(r"\S+", last))
    if len(words) < 3:
        return []
    g = random.Random(xxhash.xxh64_intdigest(f"{prompt}\0{response}", 9))  # the same wherever the row lies
    k = words[g.randrange(1, len(words))]
    inside = g.random() < 0.3 and len(k.group()) > 2  # within a word, or before it
    at = k.start() + g.randrange(1, len(k.group())) if inside else k.start()
    return [last, last[:at].rstrip()]


#: What a table without any response to learn from goes by, and the examples from which a table is learnt from.
PRIOR, LEAST_EXAMPLES = np.array([0, -0.5, 1, 2, -2, -2, 0, 0, 3, 1, 1, 0.5, 0], float), 60


class Ends:
    """Log-odds that a response's last sentence is broken off: logistic, fitted on pairs at hand whose responses we cut ourselves."""

    def __init__(self, pairs: list[tuple[str, str]], prompts: list[str]):
        """pairs: (prompt, response); the contexts are counted in the prompts."""
        self.ends = SentenceEnds(prompts)
        found = [(p, x, y) for p, r in pairs for y, x in enumerate(known_ends(p, r))]
        self.fitted, self.w = len(found), PRIOR
        if self.fitted >= LEAST_EXAMPLES:
            x, y = self._features([p for p, _, _ in found], [x for _, x, _ in found]), np.array([y for _, _, y in found], float)
            self.w = _logistic(lambda w: _newton(x, y, w), PRIOR)

    def _features(self, prompts: list[str], lasts: list[str]) -> np.ndarray:
        places = {p: k for k, p in enumerate(dict.fromkeys(prompts))}
        counted = np.array([p in self.ends.texts for p in places], bool)
        return end_features(**end_examples(list(places), [places[p] for p in prompts], lasts, counted), counts=self.ends.counts, base=self.ends.base)

    def log_odds(self, prompt: str, last: str) -> float:
        return float(self._features([prompt], [last])[0] @ self.w)

    def broken_off(self, prompt: str, response: str) -> bool:
        sign, last = last_words(prompt, response)
        return self.log_odds(prompt, last) > 0 if sign is None else sign


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The log-likelihood's curvature and, in the last row, its slope at w."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.vstack([(x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p)])


def _logistic(terms: Callable[[np.ndarray], np.ndarray], prior: np.ndarray, strength: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of the likeliest logistic model, drawn to the prior ones; Newton steps. terms: sums of `_newton` over all examples."""
    w = prior.copy()
    for _ in range(steps):
        t = terms(w)
        step = np.linalg.solve(t[:-1] + strength * np.eye(len(w)), t[-1] - strength * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.round(9)  # sums differ in their last digits with the order of the partitions


def _sentences(prompt: str) -> list[str]:
    return [s for s in _SENTENCE.split(_QUOTED.sub(" “” ", prompt)) if _WORD.search(s)]


class Judge:
    """All models together, fitted on texts at hand."""

    def __init__(self, pairs: list[tuple[str, str]], prompts: list[str]):
        self.ends = Ends(pairs, prompts)
        self.refusals = Refusals([s for t in prompts for s in _sentences(t)])

    def __call__(self, prompt: str | None, response: str | None, languages: Languages) -> str | None:
        found, last = defect(prompt, response, languages, self.refusals(response or ""))
        return found if last is None else "truncated" if self.ends.log_odds(prompt, last) > 0 else None


def defect(prompt: str | None, response: str | None, languages: Languages, declines: bool) -> tuple[str | None, str | None]:
    """The defect of a response, or None; and its last, open sentence where only the model of ends can tell whether it is truncated.

    Without a prompt only empty texts and refusals can be told.
    """
    body = _body(response or "")
    if not re.search(r"[^\W_]", body):
        return "empty", None
    if declines:
        return "refusal", None
    asked = _body(prompt or "")
    p = _WORD.findall(asked.lower())
    if not p:
        return None, None
    if copied_share(p, _WORD.findall(body.lower()), COPY) >= COPY:
        return "copy", None
    if languages.disagreement(asked, body) > 0.5:
        return "wrong_language", None
    sign, last = last_words(prompt, response)
    return ("truncated" if sign else None), (last if sign is None else None)


def _pieces(pdf: pd.DataFrame, letters: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows in runs whose prompts have so many letters together."""
    run = pdf["prompt"].str.len().fillna(0).cumsum() // letters
    yield from (x for _, x in pdf.groupby(run, sort=False))


def _stock(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prompts as slots of their sentences, and how many words and sentence ends are counted."""
    for pdf in batches:
        for piece in _pieces(pdf):
            flat, size = Refusals.packed([s for t in piece["prompt"] for s in _sentences(t)])
            words, ends = occurrences(list(piece["prompt"]))[3]
            yield pd.DataFrame({"slots": [flat.tobytes()], "sizes": [size.tobytes()], "sentences": [len(size)], "words": [words], "ends": [ends]})


def _slope(sent):
    def slope(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((Refusals.SLOTS, 3))
        for pdf in batches:
            for flat, size in zip(pdf["slots"], pdf["sizes"]):
                total += Refusals.gradient(sent.value, np.frombuffer(flat, np.uint16), np.frombuffer(size, np.uint32))
        yield pd.DataFrame({"part": [total.tobytes()]})

    return slope


def _summed(df: DataFrame, function, w: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the arrays that a function of the weights gives for each partition."""
    sent = df.sparkSession.sparkContext.broadcast(w)
    total = sum((np.frombuffer(r[0]) for r in df.mapInPandas(function(sent), "part binary").collect()), np.zeros(shape[0] * shape[1]))
    sent.unpersist()
    return total.reshape(shape)


_JUDGED = "id BIGINT, field STRING, defect STRING, block STRING, ids ARRAY<BIGINT>, fields ARRAY<STRING>, y BINARY, shape BINARY, contexts BINARY, own_seen BINARY, own_ends BINARY"
_BINARY = {"y": np.int8, "shape": np.float64, "contexts": np.uint64, "own_seen": np.int32, "own_ends": np.int32}


def _judged(sent):
    """Defects that are told without counts; in blocks, the ends to learn from (y: 0 whole, 1 cut) and those to tell (y: 2, with ids and fields)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, refusals, n = Languages(), sent.value, 0
        for pdf in batches:
            for piece in _pieces(pdf):
                rows, places, of, lasts, y, ids, fields = [], {}, [], [], [], [], []
                declines = refusals.declines([r or "" for r in piece["response"]])
                for i, field, response, prompt, no in zip(piece["id"], piece["field"], piece["response"], piece["prompt"], declines):
                    i = None if i is None else int(i)
                    found, last = defect(prompt, response, languages, no)
                    if found:
                        rows.append((i, field, found))
                    ends = [(x, k) for k, x in enumerate(known_ends(prompt, response))] if prompt is not None and response else []
                    if last is not None:
                        ends.append((last, 2))
                        ids.append(i)
                        fields.append(field)
                    for x, k in ends:
                        of.append(places.setdefault(prompt, len(places)))
                        lasts.append(x)
                        y.append(k)
                if rows:
                    out = pd.DataFrame(rows, columns=["id", "field", "defect"]).astype({"id": "Int64"})
                    yield out.assign(**dict.fromkeys(["block", "ids", "fields", *_BINARY]))
                if y:
                    x = end_examples(list(places), of, lasts) | {"y": np.array(y)}
                    row = {"id": None, "field": None, "defect": None, "block": f"{TaskContext.get().partitionId()}-{n}", "ids": ids, "fields": fields}
                    yield pd.DataFrame([row | {k: x[k].astype(t).tobytes() for k, t in _BINARY.items()}])
                    n += 1

    return judge


_PARTS = "bucket INT, block STRING, keys BINARY, seen BINARY, ended BINARY"


def _in_buckets(buckets: int, block: str | None, keys: np.ndarray, seen: np.ndarray, ended: np.ndarray) -> pd.DataFrame:
    """Ordered keys and their counts, a row for each bucket: its share of the range of the hashes."""
    edges = np.searchsorted(keys, np.array([b * ((1 << 64) // buckets) for b in range(buckets)], np.uint64)).tolist() + [len(keys)]
    rows = [(b, block, keys[i:j].tobytes(), seen[i:j].astype(np.int32).tobytes(), ended[i:j].astype(np.int32).tobytes()) for b, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "seen", "ended"])


def _counted(buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in _pieces(pdf):
                keys, _, ended, _ = occurrences(list(piece["prompt"]))
                yield _in_buckets(buckets, None, *added_up(keys, np.ones(len(keys), bool), ended))

    return count


def _wanted(buckets: int):
    def want(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, contexts in zip(pdf["block"], pdf["contexts"]):
                keys = np.unique(np.frombuffer(contexts, np.uint64))
                none = np.zeros(0)
                yield _in_buckets(buckets, block, keys[keys != 0], none, none)

    return want


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(pdf[c]), t) for c, t in (("keys", np.uint64), ("seen", np.int32), ("ended", np.int32)))


def _answers(counts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """What all prompts together say of the contexts that each block wants, in one bucket."""
    total, rows = added_up(*_joined(counts)), []
    for block, keys in zip(wanted["block"], wanted["keys"]):
        keys = np.frombuffer(keys, np.uint64)
        seen, ended = looked_up(keys, *total)
        rows.append((block, keys[seen > 0].tobytes(), seen[seen > 0].astype(np.int32).tobytes(), ended[seen > 0].astype(np.int32).tobytes()))
    return pd.DataFrame(rows, columns=["block", "keys", "seen", "ended"])


def _filled(base: float):
    def fill(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        counts, rows = added_up(*_joined(answers)), []
        for r in blocks.to_dict("records"):  # one
            a = {k: np.frombuffer(r[k], t) for k, t in _BINARY.items()}
            x = {k: a[k].reshape(len(a["y"]), -1) for k in _BINARY if k != "y"}
            x, known = end_features(**x, counts=counts, base=base), a["y"] < 2
            rows.append((x[known].tobytes(), a["y"][known].tobytes(), x[~known].tobytes(), r["ids"], r["fields"]))
        return pd.DataFrame(rows, columns=["x", "y", "open", "ids", "fields"])

    return fill


def _terms(sent):
    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(FEATURES) + 1, len(FEATURES)))
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"]):
                total += _newton(np.frombuffer(x).reshape(-1, len(FEATURES)), np.frombuffer(y, np.int8), sent.value)
        yield pd.DataFrame({"part": [total.tobytes()]})

    return terms


def _told(sent):
    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, ids, fields in zip(pdf["open"], pdf["ids"], pdf["fields"]):
                broken = np.flatnonzero(np.frombuffer(x).reshape(-1, len(FEATURES)) @ sent.value > 0)
                if len(broken):
                    yield pd.DataFrame({"id": [ids[k] for k in broken], "field": [fields[k] for k in broken], "defect": "truncated"})

    return tell


def _latest_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, prompt): the text of the latest delivery of each wanted id that has one."""
    return docs.where("text IS NOT NULL").select("id", "ingested_at", "text").join(wanted, "id", "left_semi").groupBy("id").agg(F.max_by("text", F.struct("ingested_at", "text")).alias("prompt"))


def sample_pairs(said: DataFrame, docs: DataFrame, most: int) -> tuple[list[tuple[str, str]], list[str]]:
    """Pairs and prompts of at most `most` ids, the first by hash, for trying models out on texts at hand; no query uses it."""
    ids = said.where("id IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(most)
    some = materialize(ids, "sample")  # at most `most` ids
    asked = _latest_texts(docs, F.broadcast(some))
    pairs = said.join(F.broadcast(some), "id", "left_semi").groupBy("id", "field").agg(F.min("response").alias("response"))
    rows = asked.join(pairs, "id", "left").select("id", "field", "prompt", "response").collect()
    rows.sort(key=lambda r: (r["id"], r["field"] or ""))
    return [(r["prompt"], r["response"]) for r in rows if r["response"]], list(dict.fromkeys(r["prompt"] for r in rows))


def defective_responses(rewritten: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, field, defect): each response without error that is defective; distinct rows, one defect for each response.

    A record with an impersonator answers in impersonated_text, another in obfuscated_text; NULL there is an empty response.
    Prompts are the texts of docs (the latest delivery of an id). Records of ids that docs lacks are told as far as can be
    without a prompt; NULL ids too. The models are fitted on all responses and all their distinct prompts.
    """
    sc = docs.sparkSession.sparkContext
    imp = F.col("impersonator").isNotNull()
    said = rewritten.where("error IS NULL").select(
        "id", F.when(imp, "impersonated_text").otherwise("obfuscated_text").alias("field"), F.when(imp, F.col("impersonated_text")).otherwise(F.col("obfuscated_text")).alias("response")
    ).distinct()
    asked = materialize(_latest_texts(docs, said.select("id").distinct()), "asked")
    prompts = materialize(asked.select("prompt").distinct(), "prompts")
    stock = materialize(prompts.mapInPandas(_stock, "slots BINARY, sizes BINARY, sentences BIGINT, words BIGINT, ends BIGINT"), "stock")
    sentences, words, ends = (int(x or 0) for x in stock.agg(F.sum("sentences"), F.sum("words"), F.sum("ends")).first())
    slots = stock.select("slots", "sizes")
    refusals = Refusals((sentences, lambda w: _summed(slots, _slope, w, w.shape)))

    # ids as digits: pandas would make floats of a column with NULLs
    pairs = said.join(asked, "id", "left").select(F.col("id").cast("string").alias("id"), "field", "response", "prompt")
    judged = materialize(pairs.mapInPandas(_judged(sc.broadcast(refusals)), _JUDGED), "judged")
    blocks = judged.where("block IS NOT NULL").select("block", "ids", "fields", *_BINARY)
    buckets = max(16, words // 300_000)  # about 2 million contexts in each
    counts = prompts.mapInPandas(_counted(buckets), _PARTS).groupBy("bucket")
    wanted = blocks.select("block", "contexts").mapInPandas(_wanted(buckets), _PARTS).groupBy("bucket")
    answers = counts.cogroup(wanted).applyInPandas(_answers, "block STRING, keys BINARY, seen BINARY, ended BINARY")
    filled = "x BINARY, y BINARY, open BINARY, ids ARRAY<BIGINT>, fields ARRAY<STRING>"
    filled = materialize(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_filled(base_rate(words, ends)), filled), "ends")

    known, size = filled.select("x", "y"), (len(FEATURES) + 1, len(FEATURES))
    examples = filled.agg(F.sum(F.length("y"))).first()[0] or 0
    w = _logistic(lambda w: _summed(known, _terms, w, size), PRIOR) if examples >= LEAST_EXAMPLES else PRIOR
    result = "id BIGINT, field STRING, defect STRING"
    told = filled.select("open", "ids", "fields").mapInPandas(_told(sc.broadcast(w)), result)
    return judged.where("defect IS NOT NULL").select("id", "field", "defect").unionByName(told).distinct()
