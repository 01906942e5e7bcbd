"""Training of the character tagger, in numpy, from labelled spans.

python -m quirefold.llm.pii_train DOCUMENTS.parquet [OUT.npz]: draws at most SAMPLE texts over the whole table, labels them by weak
labelling functions (pii_labels) and takes them once more with made-up sentences between theirs, fits the LSTM and the CRF by
gradient descent and writes the weights. HELD other texts are held out and scored, and so is every sixth form of sentence.
"""

from __future__ import annotations

import re
import sys
import time

import numpy as np

from quirefold.llm import pii_labels, pii_rules
from quirefold.llm.tagger import _GAP, CLASSES, TAGS, K, best_path, classes_of, emissions, halved, runs

#: Most labelled texts that are read.
SAMPLE = 8000
HELD = 1500
HIDDEN = 16
T = 112
BATCH = 192
STEPS = 3000


def labelled(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, list]]:
    """(classes, tags, spans) of the shadow of each text."""
    out = []
    for t in texts:
        s, _ = pii_rules.shadow(t)
        y = np.zeros(len(s), np.int8)
        items = pii_labels.find_items(s)
        for a, b, k in items:
            y[a:b] = TAGS.index(k)
        out.append((classes_of(s), y, items))
    return out


#: Made-up sentences; {N} is a full name, {G} a given name, {E} an email, {I} an id, {P} a phone, {A} an address.
VARIED = [
    "Yesterday {N} called about the invoice.", "The report was written by {N} last week.", "According to {N}, the index is stale.", "We thanked {N} for the review.", "My manager is {N} these days.", "{N} joined the team in March.", "{N} has not answered yet.",
    "Our new colleague {N} starts soon.", "Talk to {N} about the export.", "The patient, {N}, was seen twice.", "Nobody but {N} knows the password.", "It was {G} who found the bug.", "I asked {G} about it.", "{G} and {G} share an office.", "Tell {G} that the build is red.", "Forwarded by {N} on request.",
    "Customer: {N}", "Name: {N}", "Author: {N}", "Invited were {N}, {N} and {N}.", "The ticket of {N} is open.", "{N} wrote this note.", "{N} is on leave.", "Wir haben {N} gestern gesprochen.", "Der Bericht stammt von {N}.", "Laut {N} fehlt der Eintrag.", "{N} hat den Termin verschoben.", "Mit {G} ist das geklärt.",
    "Selon {N}, le champ reste vide.", "Le rapport de {N} est prêt.", "{N} a fermé le ticket.", "On a vu {G} au bureau.", "Según {N}, falta el campo.", "El informe de {N} está listo.", "{N} cerró el caso ayer.", "Hablé con {G} esta mañana.",
    "I saw {N} at the station.", "We met {G} for lunch.", "The letter to {N} came back.", "My name is {N} and I need help.", "Sincerely,\n{N}", "Yours,\n{G}", "Kind regards,\n{N}", "Dear {N},", "Dear {G},", "Contact: {N}, sales", "cc {N}", "{N} ({E})", "{N}, {A}", "Signed: {N}", "She spoke with {N} on the phone.", "He is married to {N}.",
    "Patient {N}, born in 1980", "Interview with {N}", "Ich habe {N} im Zug getroffen.", "Frau {N} ist verreist.", "Herr {N} kommt später.", "Sehr geehrte Frau {N},", "Nous avons vu {N} hier.", "Madame {N} est absente.", "Ayer vi a {N} en la plaza.", "El señor {N} no vino.",
    "Write to {E} soon.", "{E};", "{E}; {E}", "{N}; {E}", "{P}", "{A}", "{E}", "{N}", "You can use {E} for that.", "Mail: {E}", "{E} bounced twice.", "Her address is {E}, I think.", "Adresse: {E}.", "Escriba a {E}, por favor.", "Contact {E} or wait.", "Send it to {E} and {E}.", "Email me: {E}",
    "Her tax id is {I}.", "The number on the card was {I}.", "Please file {I} under payroll.", "Die Nummer lautet {I}.", "El número es {I}.", "Son numéro est {I}.", "Her SSN is {I}.", "The clerk typed {I} twice.", "Passport {I} has expired.", "Id {I} belongs to {N}.", "My social security number is {I}, keep it safe.",
    "Call me on {P}.", "Her number is {P}, after six.", "Phone: {P}", "Tel. {P}", "Ring {P} and ask for {G}.", "Meine Nummer ist {P}.", "Mon numéro : {P}.", "Mi teléfono es {P}.", "Fax {P} is dead.", "Text {P} or mail {E}.",
    "I live at {A}.", "Ship it to {A} please.", "Our office: {A}", "She moved to {A} last year.", "The parcel went to {A}.", "Ich wohne in der {A}.", "Nous habitons {A}.", "Vivo en {A}.", "Address: {A}", "Meet me outside {A} at noon.", "{N}\n{A}\n{P}",
]
#: The same with what is no item; {S} is a surname, {C} a made-up place, {D} a number that numbers a thing, {K} a small one.
PLAIN = [
    "The {S} library is small.", "We read the {S} paper.", "The {S} Street office is closed.", "The {S} method needs two passes.", "They moved from {C} to {C}.", "Weather in {C} was fine.", "Monday was slow, Tuesday was not.", "Open the Settings page and press Save.", "Assigned to nobody.", "Escribe a la lista.",
    "Build {D} is done.", "Order {D} was late.", "commit {D} broke it.", "Das Verfahren nach {S} ist alt.", "Die Stadt {C} liegt am Fluss.", "Viele Grüße aus dem Büro.", "Im Bogen steht nichts.", "La biblioteca {S} es lenta.", "Le port de {C} est fermé.", "Wait until noon (at the latest) please.", "Look {{at}} the brackets.",
    "Version {K}.{K}.{K} is out.", "On 2024-0{K}-1{K} at 1{K}:05:0{K} it failed.", "The total was {K},{K}45,678.90 this year.", "Ticket {D} is closed.", "See section {K}4.{K} of the manual.", "ISBN 978-{K}-16-14841{K}-0 is on loan.", "Host 10.{K}.0.1{K} is down.", "Room {K}2 is taken.", "Chapter {K} was long.", "Oak Street was closed today.", "The University of {C} replied.", "Part no. {K}2996-9{K}-X fits.", "Sincerely, the team", "Kind regards from the office", "In {C}, Sunday is quiet.", "SELECT id, title FROM glossary", "Invoice {D} for March", "Run {D} took {K} hours.",
]
_SLOTS = re.compile(r"(\{[A-Z]\})")
_GIVENS = "Maria Anna John Peter Aisha Wei Olga Ivan Fatima Noah Emma Luca Sofia Hans Greta Pierre Chloé Carlos Lucía Kwame Priya Raj Yuki Hiro Omar Leila Björn Ingrid Sean Niamh Zoë André Ahmed Elif Tomasz Zuzana Grace Thomas Sarah James".split()
_SURNAMES = "Lopez Smith Weber Schneider Dupont Moreau García Fernández O'Neill Kowalski Novák Tanaka Chen Okafor Singh Patel Haddad Yilmaz Larsen Jensen Rossi Bianchi Johnson Brown Miller Davis Nguyen Kim Park Petrov Ivanova Silva Santos Müller Köhler Lefèvre Murphy Clarke Young Martin".split()
_BITS = "bel cor dan fen gri hal jor kel lum mar nor os pel quil ras sel tor ul ven wyn yar zel an er in or ia ey ard ow".split()


#: Streets of made-up addresses, {S} a name, {K} a number.
_STREETS = ["{K}2 {S} Street", "{K} {S} Road", "{K}21B {S} Street, {C}", "{K}7 {S} Avenue, Apt {K}", "Flat {K}, {K}4 {S} Lane", "Via {S} {K}2", "Calle {S} {K}5", "{K}4 rue de {S}", "{K} avenue {S}, 7500{K} {C}", "{S}straße {K}2", "{S}weg {K}a, 1011{K} {C}", "P.O. Box {K}31", "{K}00 {S} Blvd, {C}, CA 9000{K}"]
#: Formats of made-up phones and ids; # is a digit, X a capital.
_PHONES = ["+39 06 ### #####", "+49 170 #######", "020 7946 ####", "(2##) 555-01##", "2##-555-01##", "+1 2## 555 01##", "+33 6 ## ## ## ##", "+34 6## ## ## ##", "+44 20 7946 ####", "030 ########", "+41 44 ### ## ##", "+81 3-####-####", "+91 98### #####", "06 ## ## ## ##"]
_IDS = ["9########", "###-##-####", "### ## ####", "XX######X", "########X", "X########", "## ### ### ###", "XX ## ## ## X"]


def varied(texts: list[str], forms: list[str], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, list]]:
    """labelled() of texts with sentences of forms and PLAIN put between their own; names are the texts' own, common and made up."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    shadows = [pii_rules.shadow(t)[0] for t in texts]
    known = [pii_labels.find_items(s) for s in shadows]
    own = [w.title() for s, items in zip(shadows, known) for a, b, k in items if k == "name" for w in s[a:b].split() if len(w) > 2] or _GIVENS
    made = lambda: "".join(pick(_BITS) for _ in range(int(r.integers(2, 4)))).capitalize()
    word = lambda common: pick([lambda: pick(common), lambda: pick(own), made])()

    def full() -> str:
        g, f = word(_GIVENS), word(_SURNAMES)
        return pick([f"{g} {f}"] * 5 + [f"{g} {f.upper()}", f"{g} {made()[0]}. {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g}-{word(_GIVENS)} {f}"])

    def email() -> str:
        letter = lambda: chr(97 + int(r.integers(26)))
        who = f"{pick([made, made, lambda: word(_GIVENS), letter])().lower()}{pick(['', '.', '_', '+'])}{pick([made, made, letter])().lower()}"
        end = pick(["org", "test", "example", "com", "de"])
        if r.random() < 0.5:
            return f"{pick([who, who, letter()])}@{pick([made, made, letter])().lower()}.{end}"
        o, c = pick(["()", "[]", "{}"])
        gap, out = pick(["", "", " "]), pick(["", " "])
        at = f"{out}{o}{gap}{pick(['at', 'AT', 'At'])}{gap}{c}{out}"
        dot = pick([".", ".", f"{out}{o}{gap}{pick(['dot', 'DOT'])}{gap}{c}{out}"])
        return f"{who}{at}{made().lower()}{dot}{end}"

    def filled(form: str) -> str:
        return "".join(str(int(r.integers(10))) if c == "#" else chr(65 + int(r.integers(26))) if c == "X" else c for c in form)

    def address() -> str:
        return re.sub(r"\{[SCK]\}", lambda m: {"S": lambda: word(_SURNAMES), "C": made, "K": lambda: str(int(r.integers(1, 10)))}[m[0][1]](), pick(_STREETS))

    nine = lambda: f"9{int(r.integers(10**8)):08}"
    slots = {
        "N": ("name", full), "G": ("name", lambda: word(_GIVENS)), "E": ("email", email), "I": ("identity_number", lambda: filled(pick(_IDS[:1] * 5 + _IDS))), "P": ("phone", lambda: filled(pick(_PHONES))), "A": ("street_address", address),
        "S": (None, lambda: word(_SURNAMES)), "C": (None, made), "D": (None, nine), "K": (None, lambda: str(int(r.integers(1, 10)))),
    }
    def sentence(end: str) -> tuple[str, list]:
        text, spans = "", []
        for piece in [pick(["", "", "", "cc ", "- ", "> "]), *_SLOTS.split(pick(forms if r.random() < 0.65 else PLAIN).replace("{{", "{").replace("}}", "}")), end]:
            kind, make = slots[piece[1]] if len(piece) == 3 and piece[0] == "{" else (None, None)
            x = make() if make else piece
            if kind:
                spans.append((len(text), len(text) + len(x), kind))
            text += x
        return text, spans

    def tagged(text: str, spans: list) -> tuple:
        y = np.zeros(len(text), np.int8)
        for a, b, k in spans:
            y[a:b] = TAGS.index(k)
        return classes_of(text), y, spans

    out = []
    for s, items in zip(shadows, known):
        at = [m + 2 for m in range(len(s) - 1) if s[m : m + 2] in (". ", ".\n") and all(q <= m or p > m + 1 for p, q, _ in items)]
        at = sorted({pick(at) for _ in range(3)}) if at else [len(s)]
        parts, spans, last, size = [], [], 0, 0
        for p in [*at, None]:
            parts.append(s[last:p])
            spans += [(a - last + size, b - last + size, k) for a, b, k in items if a >= last and (p is None or a < p)]
            size += len(parts[-1])
            if p is None:
                break
            last = p
            x, more = sentence(pick([" ", "\n"]))
            spans += [(a + size, b + size, k) for a, b, k in more]
            parts.append(x)
            size += len(x)
        out.append(tagged("".join(parts), spans))
    for _ in texts:  # texts of a sentence or two alone
        x, spans = sentence(pick(["", "", "\n", " "]))
        if r.random() < 0.4:
            y, more = sentence("")
            x, spans = x + y, spans + [(a + len(x), b + len(x), k) for a, b, k in more]
        out.append(tagged(x, spans))
    return out


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tags y (T, N) under emissions e (T, N, K), and its gradients."""
    t_, n, _ = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, t_):
        a[t] = e[t] + logsumexp(a[t - 1][:, :, None] + trans, 1)
    for t in range(t_ - 2, -1, -1):
        b[t] = logsumexp((b[t + 1] + e[t + 1])[:, None, :] + trans, 2)
    z = logsumexp(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    pair = np.zeros_like(trans)
    for t in range(1, t_):
        pair += np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t] - z[:, None])[:, None, :]).sum(0)
    rows, cols = np.arange(t_)[:, None], np.arange(n)[None, :]
    gold = e[rows, cols, y].sum() + trans[y[:-1], y[1:]].sum()
    de[rows, cols, y] -= 1
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float((z.sum() - gold) / (n * t_)), de / (n * t_), pair / (n * t_)


def forward(x: np.ndarray, w: dict, d: str) -> tuple[np.ndarray, list]:
    hid = w[f"U{d}"].shape[0]
    t_, n = x.shape
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    hs, keep = np.empty((t_, n, hid), np.float32), [None] * t_
    e = w[f"E{d}"] + w[f"B{d}"]
    for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
        g = e[x[t]] + h @ w[f"U{d}"]
        s = 1 / (1 + np.exp(-g[:, : 3 * hid]))
        q = np.tanh(g[:, 3 * hid :])
        c0, h0 = c, h
        c = s[:, :hid] * c0 + s[:, hid : 2 * hid] * q
        tc = np.tanh(c)
        h = s[:, 2 * hid :] * tc
        hs[t] = h
        keep[t] = (s, q, c0, h0, tc)
    return hs, keep


def backward(x: np.ndarray, dh_out: np.ndarray, keep: list, w: dict, d: str) -> tuple[np.ndarray, np.ndarray]:
    u = w[f"U{d}"]
    hid = u.shape[0]
    t_, n = x.shape
    du, de = np.zeros_like(u), np.zeros_like(w[f"E{d}"])
    dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    dgs = np.empty((t_, n, 4 * hid), np.float32)
    for t in range(t_ - 1, -1, -1) if d == "f" else range(t_):
        s, q, c0, h0, tc = keep[t]
        dh = dh + dh_out[t]
        f, i, o = s[:, :hid], s[:, hid : 2 * hid], s[:, 2 * hid :]
        dc = dc + dh * o * (1 - tc * tc)
        dg = dgs[t]
        dg[:, :hid] = dc * c0 * f * (1 - f)
        dg[:, hid : 2 * hid] = dc * q * i * (1 - i)
        dg[:, 2 * hid : 3 * hid] = dh * tc * o * (1 - o)
        dg[:, 3 * hid :] = dc * i * (1 - q * q)
        du += h0.T @ dg
        dh = dg @ u.T
        dc = dc * f
    one = np.zeros((CLASSES, t_ * n), np.float32)
    one[x.ravel(), np.arange(t_ * n)] = 1
    de += one @ dgs.reshape(-1, 4 * hid)
    return du, de


def start(hid: int, seed: int) -> dict:
    r = np.random.default_rng(seed)
    w = {"b": np.zeros(K, np.float32), "trans": np.zeros((K, K), np.float32)}
    for d in "fb":
        w[f"E{d}"] = (r.normal(size=(CLASSES, 4 * hid)) * 0.3).astype(np.float32)
        w[f"B{d}"] = np.zeros(4 * hid, np.float32)
        w[f"B{d}"][:hid] = 1.5
        w[f"U{d}"] = (r.normal(size=(hid, 4 * hid)) / np.sqrt(hid)).astype(np.float32)
        w[f"O{d}"] = (r.normal(size=(hid, K)) / np.sqrt(hid)).astype(np.float32)
    return w


def train(data: list, hid: int = HIDDEN, steps: int = STEPS, seed: int = 7, say=print) -> dict:
    r = np.random.default_rng(seed)
    gap = np.full(4, _GAP, np.uint8)
    x_all = np.concatenate([z for x, _, _ in data for z in (x, gap)])
    y_all = np.concatenate([z for _, y, _ in data for z in (y, np.zeros(4, np.int8))])
    inside = np.flatnonzero(np.diff(np.concatenate([[0], y_all])) > 0)
    w = start(hid, seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    began = time.time()
    for step in range(1, steps + 1):
        near = inside[r.integers(0, len(inside), BATCH // 2)] - r.integers(0, T, BATCH // 2)
        at = np.clip(np.concatenate([near, r.integers(0, len(x_all) - T, BATCH - BATCH // 2)]), 0, len(x_all) - T)
        idx = at[None, :] + np.arange(T)[:, None]
        x, y = x_all[idx], y_all[idx].astype(int)
        hf, kf = forward(x, w, "f")
        hb, kb = forward(x, w, "b")
        e = hf @ w["Of"] + hb @ w["Ob"] + w["b"]
        loss, de, dtrans = crf_loss(e, y, w["trans"])
        g = {"trans": dtrans, "b": de.sum((0, 1))}
        for d, h, kept in (("f", hf, kf), ("b", hb, kb)):
            g[f"O{d}"] = np.tensordot(h, de, ((0, 1), (0, 1)))
            g[f"U{d}"], g[f"E{d}"] = backward(x, de @ w[f"O{d}"].T, kept, w, d)
            g[f"B{d}"] = g[f"E{d}"].sum(0)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.012 * min(1, step / 100) * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
        for k, v in g.items():
            v = v * min(1, 0.25 / (size + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.995 * m2[k] + 0.005 * v * v
            w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        if step % 200 == 0:
            say(f"{step} loss {loss:.5f} {time.time() - began:.0f} s", flush=True)
    return w


def score(data: list, w: dict, lead: float = 0.0) -> dict[str, tuple[float, float]]:
    """Of each kind, the share of labelled spans that the tagger touches, and of its runs that touch one."""
    h = halved(w)
    hit, want, good, got = (dict.fromkeys(TAGS[1:], 0) for _ in range(4))
    for x, _, items in data:
        found = runs(best_path(emissions([x], h)[0], w["trans"], lead)) if len(x) else []
        for a, b, k in items:
            want[k] += 1
            hit[k] += any(TAGS[t] == k and p < b and q > a for p, q, t in found)
        for p, q, t in found:
            got[TAGS[t]] += 1
            good[TAGS[t]] += any(TAGS[t] == k and p < b and q > a for a, b, k in items)
    return {k: (hit[k] / max(1, want[k]), good[k] / max(1, got[k])) for k in TAGS[1:]}


def main(src: str, out: str, hid: int = HIDDEN, steps: int = STEPS) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(src, columns=["text"])["text"].to_pylist() if t]
    texts = [texts[k] for k in np.random.default_rng(5).permutation(len(texts))[: SAMPLE + HELD]]
    held, seen = texts[:HELD], texts[HELD:]
    known, unknown = [x for k, x in enumerate(VARIED) if k % 6], VARIED[::6]
    w = train(labelled(seen) + varied(seen, known), hid, steps)
    np.savez_compressed(out, **w)
    for lead in (0.0,):
        print(lead, "texts", score(labelled(held), w, lead), "known forms", score(varied(held, known, 12), w, lead), "unknown forms", score(varied(held, unknown, 13), w, lead))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "pii_model.npz", *map(int, sys.argv[3:5]))
