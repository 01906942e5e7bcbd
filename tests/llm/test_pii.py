import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import pii, pii_labels, pii_rules, pii_train, tagger

CASES = [
    ("Please reach Ludmilka Lefébure at yorick+scan (at) example dot org before noon.", [("name", "Ludmilka"), ("email", "yorick+scan")]),
    ("Questions **go** to a.b@mail.example.org or (305) 555-0188.", [("email", "a.b@"), ("phone", "(305)")]),
    ("Assigned to WHITLAW *Zelie* (ilva+scan at velm [dot] test, 17595550122).", [("name", "WHITLAW"), ("email", "ilva+scan"), ("phone", "1759")]),
    ("The form lists SSN: 000521190 next to Brisa <b>Vanterpool</b>.", [("identity_number", "000521190"), ("name", "Brisa")]),
    ("Visitors register with 666-31-4984, see Flat 16, 7715 Tallow Blvd, Osterby.", [("identity_number", "666"), ("street_address", "Flat")]),
    ("Thanks,\nDr. Kaethe A.\nP.O. Box 929, Velmouth", [("name", "Kaethe"), ("street_address", "P.O.")]),
    ("Mit freundlichen Grüßen\nI. Stellmach\nMühlgasse 62b, 00167 Sandhafen\n0049/30/23125662", [("name", "I."), ("street_address", "Mühlgasse"), ("phone", "0049")]),
    ("Livrer le dossier au 104 ter, chemin des Brumes. Joignable au 01.99.00.17.11.", [("street_address", "104"), ("phone", "01.99")]),
    ("Consta DNI: 00022878-F a nombre de Rajveer Adeyanwu. Enviar a C/ de los Vientos, 63.", [("identity_number", "00022878"), ("name", "Rajveer"), ("street_address", "C/")]),
    ("Hi Delphe, the parcel is partial. Ask Mei-Lin to merge it. Call back: +44 20 7946 0404 (Nadim)", [("name", "Delphe"), ("name", "Mei-Lin"), ("phone", "+44"), ("name", "Nadim")]),
    ("Mention @cold in the patch, not root@draft. Use pkg@1.2.3 or user@localhost.", []),
    ("The Halvard parser reads it. The Quillfen Street rollout starts. Section 43 Cache Lane of the handbook.", []),
    ("Build 204906707 and commit 46508c0; Order 48-32-244; Part no. 52996-99-X; 10.45.0.162 at 14:05:33 on 2024-10-10.", []),
]


UNSEEN = ("I met {} yesterday.", "We had lunch with {} on Friday.", "The complaint of {} was rejected.", "He married {} in 2019.", "Gestern traf ich {} im Zug.", "Nous avons rencontré {} hier.", "Ayer vi a {} en la plaza.", "My neighbour {} complained again.")


@pytest.mark.parametrize("text,want", CASES)
def test_found_by_the_tagger_and_checked(text, want):
    for pad in ("", "Nobody noticed that the index had become missing. " * 3):
        t = pad + text
        got = [(k, t[a:b]) for a, b, k in pii.find([t], pii.weights())[0]]
        assert [k for k, _ in got] == [k for k, _ in want], got
        assert all(x.startswith(w) for (_, x), (_, w) in zip(got, want)), got


@pytest.mark.parametrize("email", ["jane.doe {at} example.org", "jane (AT) example.org", "jane ( at ) example.org", "jane [ At ] example.org", "jane at example dOt org", "jane@example.org"])
def test_every_email_that_the_shape_takes_is_searched(email):
    s = f"Questions go to {email}, please."
    assert pii_rules.EMAIL.search(s)[0] == email
    assert [(s[a:b], k) for a, b, k in pii_labels.annotate(s)] == [(email, "email")]
    assert pii_rules.shadow("\\emph{at} {\\it at}")[0] == "at at"


def test_names_and_numbers_need_no_known_sentence():
    w = pii.weights()
    assert not any(c in pii_train.VARIED for c in UNSEEN)
    got = [(x, [(t[a:b], k) for a, b, k in pii.find([t], w)[0]]) for c in UNSEEN for x in ("Maria Lopez", "Jonas Weber", "Aisha Okonkwo", "Mei-Lin Zhao") for t in [c.format(x)]]
    assert sum(g == [(x, "name")] for x, g in got) > len(got) / 2, got
    t = "I met Maria Lopez yesterday. The clerk typed 912345678 twice."
    assert pii.redact(t, pii.find([t], w)[0]) == "I met [NAME] yesterday. The clerk typed [ID_NUMBER] twice."
    t = "The Halvard parser reads it. Build 912345678 is done, Order 987654321 too."
    assert pii.find([t], w)[0] == []


def test_places_count_code_points_of_the_text():
    t = "🙂 caf\u00e9 \ufeff &amp; \\emph{Hi} [Delphe](http://x), the end"
    a, b, k = pii.find([t], pii.weights())[0][0]
    assert (t[a:b], k) == ("Delphe", "name")


def test_shadow_maps_back():
    t = "a **b** <i>c</i> \\emph{d} [[x|e]] [f](u) &lt;g"
    s, at = pii_rules.shadow(t)
    assert s == "a b c d e f <g" and [t[i] for i in at[:-1]][:7] == list("a b c d") and len(at) == len(s) + 1
    assert pii_rules.shadow("plain")[1] is None


def test_table(spark):
    rows = [(1, "cc a@b.example; c@d.example"), (2, None), (3, ""), (1, "cc a@b.example;"), (None, "cc a@b.example;"), (5, "We should. " * 30_000 + "cc a@b.example;")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = sorted((str(r[0]), r[1], r[2]) for r in pii.find_pii(df).collect())
    assert got == sorted([("1", "email", 3), ("1", "email", 16), ("1", "email", 3), ("None", "email", 3), ("5", "email", 330_003)])
    red = {r["doc_id"]: r["redacted"] for r in pii.redact_texts(df.where("doc_id IN (2, 3, 5)")).collect()}
    assert red[2] is None and red[3] == "" and red[5].endswith("should. cc [EMAIL];")
    assert pii.find_pii(df.limit(0)).count() == 0


def test_held_out_recall(spark):
    """Held-out accuracy: texts the model has not seen, labels from the exact shapes."""
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    want = [{(a, k) for a, _, k in pii_labels.annotate(t)} for t in texts]
    got = [{(a, k) for a, _, k in x} for x in pii.find(texts, pii.weights())]
    hit, n, m = sum(len(w & g) for w, g in zip(want, got)), sum(map(len, want)), sum(map(len, got))
    assert n > 500 and hit / n > 0.99 and hit / m > 0.99


def test_decoder_is_the_best_allowed_path():
    r = np.random.default_rng(0)
    e, trans = r.normal(size=(7, tagger.K)).astype(np.float32), r.normal(size=(tagger.K, tagger.K)).astype(np.float32) * 0.3
    import itertools

    best, arg = -1e9, None
    for p in itertools.product(range(3), repeat=7):  # fewer tags: the others are made impossible
        if any(a and b and a != b for a, b in zip(p, p[1:])):
            continue
        v = sum(e[i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip((0, *p), (*p, 0)))
        if v > best:
            best, arg = v, p
    e[:, 3:] = -100
    assert tuple(tagger.best_path(e, trans)) == arg


def test_windows_agree_with_one_pass():
    w = pii.weights()
    t = ("Please reach Kelda Torsk at k@example.org before noon. " * 40)[:2100]
    x = tagger.classes_of(t)
    a = tagger.emissions([x], w)[0]
    z = np.concatenate([np.full(tagger.EDGE, tagger._GAP, np.uint8), x, np.full(tagger.EDGE, tagger._GAP, np.uint8)])
    live = np.ones(len(z), int)
    one, back = np.zeros((len(z), 1, tagger.K), np.float32) + w["b"], np.zeros((len(z), 1, tagger.K), np.float32)
    tagger._direction(z[:, None], live, w, "f", one), tagger._direction(z[::-1, None], live, w, "b", back)
    whole = (one[:, 0] + back[::-1, 0])[tagger.EDGE : -tagger.EDGE]
    assert (tagger.best_path(a, w["trans"]) == tagger.best_path(whole, w["trans"])).mean() > 0.995


def test_neighbours_make_no_difference():
    """A text has the same items alone and among any others, in any order, whatever they hold."""
    r = np.random.default_rng(3)
    w = pii.weights()
    some = [c for c, _ in CASES] + [c.format("Maria Lopez") for c in UNSEEN] + ["Ask Anna to call 212-555-0100.", "Best,\nPeter Lopez", "x", " ", "A", "John"]
    noise = ["Nobody noticed that the index had become missing. " * 30, "x" * 3000, "\n" * 500, "a b " * 700, "12345678901234567890" * 20]
    alone = {t: pii.find([t], w)[0] for t in some}
    for _ in range(4):
        mixed = [str(t) for t in r.permutation([*some, *noise, *some[:9]])]
        assert [g for t, g in zip(mixed, pii.find(mixed, w)) if t in alone] == [alone[t] for t in mixed if t in alone]


def test_same_rows_under_any_partitioning(spark):
    rows = [(k, t) for k, t in enumerate([c for c, _ in CASES] * 3 + ["Nobody noticed. " * 40, "y" * 900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, pii.find_pii(df.coalesce(1)).collect()))
    assert len(want) > 60
    for n in (2, 7):
        assert sorted(map(tuple, pii.find_pii(df.repartition(n, "doc_id")).collect())) == want


def test_edges_are_trimmed_to_shapes():
    at = lambda s, run, kind: (lambda x: s[x[0] : x[1]] if x else None)(pii_rules.item_of(s, s.index(run), s.index(run) + len(run), kind))
    assert at("I live at 12 Oak Street. Come by", "12 Oak Street. ", "street_address") == "12 Oak Street"
    assert at("Her SSN is 123-45-6789.", " is 123-45-6789", "identity_number") == "123-45-6789"
    assert at("mail a.b@example.org, please", "b@example.or", "email") == "a.b@example.org"
    assert at("call +39 06 698 12345 now", " +39 06 698 12345 ", "phone") == "+39 06 698 12345"  # no shape of its own: the run itself
    assert at("in Via Roma 12 now", " Via Roma 1", "street_address") == "Via Roma 12"
    assert at("met Maria Lopez", "aria Lope", "name") == "Maria Lopez" and at("by Dr. Anna Weber", "Dr. Anna Weber", "name") == "Anna Weber"
    assert at("cold words here", "cold words", "name") is None  # nothing that a name begins with is left


def test_training_learns():
    data = pii_train.labelled(["Questions go to ab@example.org or x. " * 6, "cc q.r@mail.example; nothing else here at all. " * 6] * 4)
    pii_train_t, pii_train.T = pii_train.T, 48
    try:
        w = pii_train.train(data, hid=8, steps=120, say=lambda *a, **k: None)
    finally:
        pii_train.T = pii_train_t
    assert pii_train.score(data, w)["email"][0] > 0.9


def test_gradient_of_the_crf():
    r = np.random.default_rng(1)
    e, y, tr = r.normal(size=(5, 2, tagger.K)), r.integers(0, tagger.K, (5, 2)), r.normal(size=(tagger.K, tagger.K))
    _, de, dt = pii_train.crf_loss(e, y, tr)
    for i in ((0, 0, 1), (3, 1, 2)):
        d = np.zeros_like(e)
        d[i] = 1e-5
        assert abs((pii_train.crf_loss(e + d, y, tr)[0] - pii_train.crf_loss(e - d, y, tr)[0]) / 2e-5 - de[i]) < 1e-6
    d = np.zeros_like(tr)
    d[1, 2] = 1e-5
    assert abs((pii_train.crf_loss(e, y, tr + d)[0] - pii_train.crf_loss(e, y, tr - d)[0]) / 2e-5 - dt[1, 2]) < 1e-6


def test_the_recurrence_costs_less_than_its_plain_form():
    """p10_found: the same emissions as the textbook's steps, window by window of rows, in well under their CPU time."""
    import time

    with np.load(pii.MODEL) as z:
        raw = {k: z[k] for k in z.files}
    hid = raw["Uf"].shape[0]
    scale = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), hid)
    e, u = (raw["Ef"] + raw["Bf"]) * scale, raw["Uf"] * scale

    def plain(x, live, emit):
        n = x.shape[1]
        h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        g, r = np.empty((n, 4 * hid), np.float32), np.empty((n, 4 * hid), np.float32)
        for t in range(len(x)):
            m = int(live[t])
            h, c, g, r = h[:m], c[:m], g[:m], r[:m]
            np.take(e, x[t, :m], axis=0, out=g)
            np.dot(h, u, out=r)
            g += r
            np.tanh(g, out=g)
            s = g[:, : 3 * hid]
            s *= 0.5
            s += 0.5
            c *= s[:, :hid]
            c += s[:, hid : 2 * hid] * g[:, 3 * hid :]
            np.tanh(c, out=h)
            h *= s[:, 2 * hid :]
            emit[t, :m] += h @ raw["Of"]

    r = np.random.default_rng(5)
    x = r.integers(0, tagger.CLASSES, (tagger.WINDOW, tagger.ROWS)).astype(np.uint8)
    live = np.concatenate([np.full(200, tagger.ROWS), np.linspace(tagger.ROWS, 1, tagger.WINDOW - 200).astype(int)])
    w = pii.weights()

    def best(f):
        took = []
        for _ in range(5):
            emit = np.zeros((*x.shape, tagger.K), np.float32)
            began = time.process_time()
            f(emit)
            took.append(time.process_time() - began)
        return min(took), emit

    (slow, want), (fast, got) = best(lambda y: plain(x, live, y)), best(lambda y: tagger._direction(x, live, w, "f", y))
    assert np.abs(want - got).max() < 1e-4
    assert fast < 0.8 * slow, (fast, slow)


def test_paths_of_many_streams_score_best():
    """Stretches of many lengths, more than are decoded side by side: each path's score is that of a search over its whole stream."""
    r = np.random.default_rng(6)
    trans = (r.normal(size=(tagger.K, tagger.K)) * 0.3 - np.where(np.eye(tagger.K), 0, 2)).astype(np.float32)
    apart = ~((np.arange(tagger.K)[:, None] > 0) & (np.arange(tagger.K) > 0)) | np.eye(tagger.K, dtype=bool)
    allowed = np.where(apart, trans, -1e9)
    sizes = [0, 1, 2, 5, *r.integers(1, 900, 12), *[3] * tagger.SIDE]
    each = []
    for n in sizes:
        e = r.normal(size=(n, tagger.K)).astype(np.float32)
        e[:, 0] += np.where(r.random(n) < 0.05, -6, 6)
        each.append(e)
    for e, p in zip(each, tagger.best_paths(each, trans)):
        assert len(p) == len(e) and all(apart[a, b] for a, b in zip(p, p[1:]))
        if len(e):
            v = np.where(np.arange(tagger.K) == 0, 0, -1e9)
            for x in e:
                v = (v[:, None] + allowed).max(0) + x
            path = [0, *p, 0]
            assert abs((v + allowed[:, 0]).max() - e[np.arange(len(e)), p].sum() - trans[path[:-1], path[1:]].sum()) < 1e-2


def test_shadow_of_entities_without_a_character():
    t = "a &nosuch; **b** &lt;"
    s, at = pii_rules.shadow(t)
    assert s == "a &nosuch; b <" and list(at) == [0, 1, *[2] * 8, 10, 13, 16, 17, 21]
    assert pii_rules.shadow("**")[0] == "" and list(pii_rules.shadow("**")[1]) == [2]
