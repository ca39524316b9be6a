"""Personal names in free text, by a linear model over candidates.

A candidate is a run of two to four capitalised words, particles between them aside, or two words one of which is a
common given name. The model weighs what the words look like and what stands around them; it is trained here, on
sentences made of the lists below, whose number is a parameter, and measured on names and wordings that it never saw.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

SAMPLE = 10_000  # sentences that the model is trained on

# Common given names.
GIVEN = frozenset(
    "aisha alex alexander amara amelia amira andrea andreas anna anne anton arvid aylin basil ben benjamin bernd birgit britta bruno carla carlos "
    "charlotte christian clara claudia daniel david dilara elena elif elias elisabeth emil emilia emma erik eva fatima felix finn florian francesca "
    "frank franz freya frieda georg greta hanna hannah hans heike helen helena henrik ida igor ines ingrid isabel ivan jakob jan jana jens joana "
    "johanna john jonas julia julian karim karin karl katrin kenji klaus lara lars laura lea lena leon leonie lina linda lisa lukas mai marek maria "
    "marie marta martin mary matthias max maya mehmet mia michael mila milan mira moritz nadia nico niklas nina noah noemi nora olga oliver omar "
    "oskar paul paula peter petra philipp priya rasmus robert rosa ruben sabine sara sarah simon sofia sofie stefan susanne sven thomas tilda tim "
    "timo tobias tom tomas ursula vera victor yara yusuf zofia".split()
)
# Given names and family names of the training sentences beside those above, and those held out.
MORE_GIVEN = (
    "Li Jun Min Hao Xin Yan Hiroshi Yuki Sakura Takeshi Ananya Arjun Deepak Sunita Vikram Lakshmi Nguyen Thanh Linh Huy Tuan Chidi Ngozi Kwame Abena Fatou Moussa Tariq Layla Hassan Leila Reza Shirin "
    "Sergei Natalia Dmitri Oksana Piotr Agnieszka Jiri Lucie Gabor Zsofia Ion Mihaela Luca Chiara Marco Matteo Pierre Camille Antoine Sylvie Diego Lucia Javier Pilar Joao Beatriz Rui Niamh Sean Aoife Callum Rhys Megan Wolfgang Dieter Jurgen"
).split()
MORE_FAMILY = (
    "Chen Liu Huang Yang Zhao Wu Tanaka Suzuki Yamamoto Kim Park Choi Sharma Patel Singh Reddy Iyer Gupta Tran Pham Le Vo Okafor Adeyemi Mensah Diallo Traore Haddad Mansour Khalil Hosseini Rahimi "
    "Ivanov Petrova Kovalenko Nowak Kowalski Dvorak Novak Nagy Horvath Popescu Ionescu Bianchi Ricci Conti Dubois Lefevre Moreau Garnier Garcia Fernandez Lopez Serrano Silva Santos Pereira Murphy Byrne Kelly MacLeod Evans "
    "Schmidt Fischer Weber Wagner Becker Hoffmann Schäfer Koch Richter Klein Schröder Neumann Schwarz Zimmermann Braun Krüger Andersson Nilsson Hansen Larsen Virtanen Korhonen Jansen Bakker Visser Smith Brown Taylor Walker Clark O'Neill O'Brien D'Angelo"
).split()
HELD_GIVEN = "Wei Rajesh Siobhan Minh Giulia Heinrich Mei Kenta Divya Sanjay Phuong Emeka Zainab Ibrahim Parisa Vladimir Katarzyna Tomasz Istvan Radu Alessia Lorenzo Celine Thierry Alvaro Carmen Tiago Soraia Ciaran Gethin Eilidh Gerhard Ottilie Sigrid Aino Pieter Bram Dorothy Eugene Winifred".split()
HELD_FAMILY = "Zhang Kumar O'Connor Rossi Müller-Lüdenscheidt Wang Nakamura Krishnan Mukherjee Hoang Eze Balogun Farouk Karimi Sokolov Wisniewski Zielinski Szabo Dumitru Ferrari Greco Fontaine Girard Navarro Ortega Carvalho Gomes Gallagher Doyle Pritchard McAllister Lehmann Vogel Bergström Mäkinen Dijkstra Vermeulen Thompson Whitfield Abernathy".split()
PARTICLES = frozenset("van von der den de da di del dos la le bin al el ben ter zu".split())
PREPOSITIONS = frozenset("von der den de zu al".split())  # particles only behind a given name, elsewhere common words
# Common English words that are no names, and German ones.
COMMON = frozenset(
    "a about access account after alert all also am and annual answer any approval approved are asset at audit authority backup badge bank black blue board build building "
    "business but by call campus cell central change checked chief client cloud code committee company contact control copy council critical customer data database december "
    "deliver department desk digital director division document draft drive duplicate english entry europe european excel export external factory field file finance for form "
    "framework friday from gate gateway general german golden green grey group hall hash head high house how identity incident information internal interval is island it "
    "january key lake letter level list mail management manager march market master may media monday needs network new next no north note notes number of office officer on "
    "open operations order our out owner park partner people phase plan please policy port portal production program project provider purchase quality quarterly quote red "
    "report request research review reviewer risk room sample score security see senior server service session sheet short sign signature silver site south staff stage "
    "standard station status steering street success summary sunday supplier support system team technical test the this thursday ticket to tower tuesday type union unit "
    "university update user vendor version water wednesday weekend west when white windows wing wording workshop".split()
) | frozenset("an anhang auf aus bei bitte dank das dem der die ein eine erreichbar für gez im in ist januar laut mit personalausweis rückfragen siehe steuer tel und unterschrift von wohnhaft zu zum zur".split())
# Phrases in capitals that are no names; those held out are at the end.
PHRASES = (
    "Red Team|Blue Team|Chief Security Officer|Data Protection Officer|Senior Risk Manager|Head of Audit|Project Falcon|Project Silver Lake|Steering Board|Security Office|Data Center North|Access Control|Change Advisory Board|North Gate|Main Building|Server Room|Amber Warning|Green Field|Silver Line|Golden Gate|Human Resources|Patch Tuesday|Black Box|"
    "Risk Register|Finance Department|Quality Manual|Annual Report|Disaster Recovery|Cloud Platform|Admin Portal|Friday Update|Friday Gate|Monday Report|March Release|Version Two|Phase One|Hash Value|Interval Check|Owner Missing|Duplicate Entry|Wording Unclear|Sample Size|Backup Road|"
    "Der Nachweis|Die Frist|Das Protokoll|Im Bericht|Im Anhang|Siehe Ticket|Siehe Anlage|Bitte Beleg|Bitte Frist|Für Rechenzentrum|Für Standort|Bei Vorgang|Zu Antrag|Betrieb, Netze|Verträge, Straße|Konten, Rechte|Listen, Pläne|Protokolle, Berichte|Anträge, Gebäude|Bereich Technik|Abteilung Einkauf|Rückfrage Vertrieb|Stand Freitag|"
    "Note Export|Rückfrage Beleg|When Northfield|Für Eichstadt|Westheim Backup|Oldmere Interval|In Brookfield|Follow-up Export"
).split("|")
HELD_PHRASES = (
    "Purple Team|Project Orion|Audit Committee|Network Operations|Incident Response|Identity Provider|South Wing|Supplier Portal|Key Vault|Change Window|Thursday Session|Release Notes|Customer Success|Crisis Staff|Amber Light|Blue Print|Internal Audit|Data Protection|"
    "Die Prüfung|Der Vertrag|Im Protokoll|Siehe Bericht|Bitte Auszug|Für Niederlassung|Bei Störung|Berichte, Netze|Pläne, Verträge|Abteilung Revision|In Westbrook|Bereich Einkauf"
).split("|")
# Wordings around a name, and those held out.
WORDINGS = (
    "Spoke with {n} about the gap|Contacted {n} today|call {n} before noon|per phone with {n}|cc {n}|{n} will send it|{n} has agreed|{n} confirmed the date|{n} wrote the plan|{n} said no|Signed: {n}|Signature: {n}|signed by {n}|according to {n}, this is fine|"
    "came from {n} last week|replaced by {n}!|Owner is {n}.|Owner: {n}|Ask {n} again|thanks to {n}|forwarded to {n} and closed|Email from {n} on Monday|{n} is on leave|Interview: {n}, site lead|Scan of {n} shows passport|copy of {n}'s card|forwarded, {n}|{n}, 12 Hill Road|"
    "Gez. {n}|Laut {n} fehlt es|Dank an {n} für den Hinweis|bitte {n} fragen|Unterschrift {n} fehlt|Rücksprache mit {n}|von {n} geprüft|{n} hat zugesagt|{n} ist der Ansprechpartner|Ansprechpartner: {n}|{n}|{n}; fine|ok {n}|{n} - see above|Meeting: {n} and {m}|{n}, {m} attended|the letter for {n} was sent|fine. {n} knows more|{n} about the form|"
    "{n}, nothing changed|{n} last week|{n} ok"
).split("|")
HELD_WORDINGS = "Contact {n} first|{n} will present the results|ask {n}|met {n} yesterday|reviewed by {n}|approved by {n}|Please inform {n} at once|{n} left the company|handed over to {n}|{n} declined|The report by {n} is late|In Abstimmung mit {n}|{n} hat das bestätigt|Vertretung durch {n}|An {n} weitergeleitet|talk to {n} please|{n} was not reachable|witness: {n}|as {n} explained|minutes taken by {n}".split("|")
# What else a note says.
FILLERS = (
    "The {p} met on Monday|{p} was closed|see {p}|{p} is a code word|{p} passed|Needs a newer date|score 12.5 {p}|{p} and {q} disagree|the {p} agreed|{p} for March|moved to {p}|{p} nachreichen|{p} fehlt|of {p}.|{p}: 4 items|{p}|Room 5, {p} was tested|mail gateway @ {p}|{p} 42 refers to it|checked by {p}|{p} said no|ok {p}|{p} is on hold|{p} endete früh|owned by the {p}|from {p} last week|by {p}|{p} will follow|{p} has changed|contact the {p}|order 7 refers to {x}|Nachweis zu {x}|Ausfall von {x} am Montag|{x} lists 12 rights|{x} keeps 4 accounts|a form for {x}|moved to {x}|Für {x} gilt das|Bei {x} fehlt etwas|when {x} closed|the clerk of {x}|{x}: 5 items|gateway at {x} was tested|owned by {x}|zone of {x}|Bereich {x} 54 Listen|Konto {x} 12|der Standort {x} meldet|Team {x} said no"
).split("|")

_ACRONYM = re.compile(r"^[A-ZÄÖÜ]{2,}-|-[A-ZÄÖÜ]{2,}$|-Nr$")
_JOINED = re.compile(r"[@\d_]|-\w|\.\w")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_END = re.compile(r"[.!?;:\n]\s*$")
Span = tuple[int, int]
_WORD = r"[^\W\d_]+(?:-[^\W\d_]+)*"
_PAIR = re.compile(rf"(?<![\w\-@.])(?P<a>{_WORD})(?P<sep>,? )(?=(?P<b>{_WORD})(?![\w\-@]))")


def pairs(text: str) -> Iterator[Span]:
    """Two capitalised words, one of them a common given name before, or behind a comma or capitals after, a word that is
    no common one."""
    for m in _PAIR.finditer(text):
        a, b, comma = m["a"], m["b"], m["sep"] == ", "
        if not a[0].isupper() or not b[0].isupper():
            continue
        if not comma and a.lower() in GIVEN and len(b) > 2 and b.lower() not in COMMON or b.lower() in GIVEN and len(a) > 2 and a.lower() not in COMMON and (comma or a.isupper()):
            yield m.start("a"), m.end("b")


def _shape(word: str) -> str:
    return "U" if len(word) > 1 and word.isupper() else "T" if word[0].isupper() else "l"


def _sign(after: str) -> str:
    first = after.strip()[:1]
    return "digit" if first.isdecimal() else first


def candidates(text: str) -> Iterator[tuple[list[re.Match[str]], int, int]]:
    """(tokens, first, last): successive words that may be a name, one blank or comma and blank between them."""
    tokens = list(_TOKEN.finditer(text))
    n = len(tokens)
    own = [t[0] for t in tokens]
    title = [w[0].isupper() and len(w) > 1 and not _ACRONYM.search(w) for w in own]
    given = [w.lower() in GIVEN for w in own]
    close = [text[a.end() : b.start()] in (" ", ", ") for a, b in zip(tokens, tokens[1:], strict=False)]
    comma = [text[a.end() : b.start()] == ", " for a, b in zip(tokens, tokens[1:], strict=False)]
    for i in range(n - 1):
        if not (title[i] or given[i] or (close[i] and given[i + 1])) or tokens[i].start() and text[tokens[i].start() - 1] in "@_.-0123456789":
            continue
        commas = 0
        for j in range(i + 1, min(i + 5, n)):
            if not close[j - 1]:
                break
            commas += comma[j - 1]
            if commas > 1 or commas and j > i + 1:
                break
            particle = own[j] in PARTICLES and (given[j - 1] or own[j] not in PREPOSITIONS or own[j - 1] in PARTICLES)
            if not (title[j] or particle or j == i + 1 and (given[i] or given[j])):
                break
            if particle:
                continue
            if _JOINED.match(text, tokens[j].end()):
                break
            yield tokens, i, j


def features(text: str, tokens: list[re.Match[str]], i: int, j: int) -> list[str]:
    """What the model sees of tokens i to j."""
    words = [t[0] for t in tokens[i : j + 1]]
    low = [w.lower() for w in words]
    before, after = text[max(0, tokens[i].start() - 3) : tokens[i].start()], text[tokens[j].end() : tokens[j].end() + 3]
    prev = tokens[i - 1][0] if i and len(text[tokens[i - 1].end() : tokens[i].start()].strip()) == 0 else ""
    following = tokens[j + 1][0] if j + 1 < len(tokens) and len(text[tokens[j].end() : tokens[j + 1].start()].strip()) == 0 else ""
    start = not before.strip() and not i or bool(_END.search(before))
    shape = "".join(map(_shape, words))
    comma = "," in text[tokens[i].end() : tokens[i + 1].start()]
    known = [w in GIVEN for w in low]
    plain = [w in COMMON for w in low]
    out = [
        "bias", f"n{len(words)}", f"shape {shape}", f"comma {comma}", f"comma {comma} given {known[0]} {known[-1]}", f"given first {known[0]} {shape[0]}", f"given last {known[-1]} {shape[-1]}", f"given {sum(known)} of {len(words)}", f"given first {known[0]} common {sum(plain)}",
        f"common first {plain[0]}", f"common last {plain[-1]}", f"common {sum(plain)}", f"all common {all(plain)}", f"any common {any(plain)} given {any(known)}", f"start {start}", f"start {start} given {known[0]}", f"shape {shape} given {known[0]} {known[-1]}",
        f"before {prev.lower()}", f"after {following.lower()}", f"before is common {prev.lower() in COMMON} {prev[:1].isupper()}", f"after is {_shape(following) if following else _sign(after)}", f"mark before {before.strip()[-1:]}", f"mark after {after[:1]}",
        f"after is common {following.lower() in COMMON} {following[:1].isupper()}", f"before is given {prev.lower() in GIVEN}",
    ]
    for k, w in (("first", low[0]), ("last", low[-1])):
        out += [f"{k} {w[-2:]}", f"{k} {w[-3:]}", f"{k} long {min(len(w), 9)}"]
    if any("'" in w or "-" in w for w in words):
        out.append("joined")
    if any(w in PARTICLES for w in low[1:-1]):
        out.append("particle")
    return out


class NameModel:
    """Weights of features; a score above the threshold is a name."""

    def __init__(self, weights: dict[str, float], threshold: float = -1.6) -> None:
        self.weights, self.threshold = weights, threshold

    def score(self, text: str, tokens: list[re.Match[str]], i: int, j: int) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(text, tokens, i, j))

    def names(self, text: str) -> list[Span]:
        """Places of the names, the surest of those that overlap."""
        scored = [(s, t[i].start(), t[j].end()) for t, i, j in candidates(text) if (s := self.score(text, t, i, j)) > self.threshold]
        kept: list[Span] = []
        for _, a, z in sorted(scored, key=lambda x: (-x[0], x[1])):
            if all(z <= b or y <= a for b, y in kept):
                kept.append((a, z))
        return sorted(kept)


_WORDY = ("before", "after", "first", "last")
_SYLLABLES = "an bel cor dor ek fel gar hol in jas kal lor mar nov ol per qua ras sten tor ul vin wes yar zel umb iri bren".split()
_GIVEN_ENDINGS = "a an ia ich il im in ine io is o on rad us wen y".split()
_PLACES = "al ane et fall gar gor holm is ix kel mar mere mond nal nox on or port quin rex ric stadt sted tal tis vane wick zen".split()
_ENDINGS = "en er ik ström berg ski ari son ov mann ath hagen bruk thal eau iez ez ini ro wood ley".split()


def _made_up(rnd: random.Random, endings: list[str]) -> str:
    return "".join(rnd.choices(_SYLLABLES, k=rnd.randint(1, 2)) + [rnd.choice(endings)]).capitalize()


def sentences(n: int, seed: int, given: list[str], family: list[str], wordings: list[str], phrases: list[str], odd: bool = True) -> Iterator[tuple[str, list[Span]]]:
    """(text, places of names) of n made sentences. odd: also names in other letter case or order."""
    rnd = random.Random(seed)

    def person() -> str:
        g, f = rnd.choice(given), rnd.choice(family)
        if odd:
            g = _made_up(rnd, _GIVEN_ENDINGS) if rnd.random() < 0.25 else g
            f = _made_up(rnd, _ENDINGS) if rnd.random() < 0.5 else f
        if rnd.random() < 0.06:
            f = f"{f}-{rnd.choice(family)}" if "-" not in f else f
        if rnd.random() < 0.08:
            f = f"{rnd.choice(['van', 'von', 'de', 'di', 'da'])} {f}"
        if rnd.random() < 0.12:
            g = f"{g} {rnd.choice(given)}"
        way = rnd.random() if odd else 1
        if way < 0.12 and g.lower() in GIVEN and " " not in f:
            return f"{g} {f}".lower()
        return f"{f.upper()} {g}" if way < 0.19 else f"{f}, {g}" if way < 0.27 and " " not in f and g.lower() in GIVEN else f"{g} {f}"

    for _ in range(n):
        parts, at, spans = [], 0, []
        for _ in range(rnd.choice((1, 1, 2, 3))):
            if rnd.random() < 0.55:
                form = rnd.choice(wordings)
                for piece in re.split(r"(\{[nm]\})", form):
                    said = person() if piece in ("{n}", "{m}") else piece
                    if said is not piece:
                        spans.append((at, at + len(said)))
                    parts.append(said)
                    at += len(said)
            else:
                form = rnd.choice(FILLERS).replace("{p}", rnd.choice(phrases)).replace("{q}", rnd.choice(phrases)).replace("{x}", _made_up(rnd, _PLACES))
                parts.append(form)
                at += len(form)
            joint = rnd.choice((" ", ". ", "; ", "\n", ".; "))
            parts.append(joint)
            at += len(joint)
        yield "".join(parts), spans


@lru_cache(2)
def trained(sample: int = SAMPLE, rounds: int = 12) -> NameModel:
    """The model, by logistic regression with decaying steps over the candidates of `sample` sentences."""
    known = [g.capitalize() for g in sorted(GIVEN)]
    examples = []
    for text, spans in sentences(sample, 1, known + MORE_GIVEN * 2, MORE_FAMILY, WORDINGS, PHRASES):
        truth = set(spans)
        examples += [(features(text, t, i, j), (t[i].start(), t[j].end()) in truth) for t, i, j in candidates(text)]
    weights: dict[str, float] = defaultdict(float)
    rnd = random.Random(2)
    for k in range(rounds):
        rnd.shuffle(examples)
        step = 0.25 / (1 + k)
        for seen, is_name in examples:
            # words themselves are hidden now and then, so that the model learns to do without those it knows
            names = [f for f in seen if f.partition(" ")[0] not in _WORDY or rnd.random() > 0.4]
            s = sum(weights[f] for f in names)
            error = is_name - 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            if abs(error) > 0.02:
                for f in names:
                    weights[f] += step * error
    return NameModel({f: w for f, w in weights.items() if abs(w) > 1e-3})


def measure(model: NameModel, sample: int = 2000, seed: int = 7) -> dict[str, float]:
    """Recall and precision on names and wordings that the model was not trained on."""
    found = right = wanted = 0
    for text, spans in sentences(sample, seed, HELD_GIVEN, HELD_FAMILY, HELD_WORDINGS, HELD_PHRASES, odd=False):
        got = set(model.names(text))
        found, right, wanted = found + len(got), right + len(got & set(spans)), wanted + len(spans)
    return {"recall": right / wanted, "precision": right / found}
