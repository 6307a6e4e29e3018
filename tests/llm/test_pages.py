import pytest

from shatterlens.llm.pages import list_pages, list_share

SENTENCES = "We compared both orders and saw a small gap. The budget of ten percent was fixed before the search began. "
SPAM = {
    "keywords": "free graph tool, best hub finder, cheap node app, online link map, free graph tool, node app online",
    "no marks": "hub finder near you hub finder price node removal software near you node removal software best hub finder",
    "sentence look": "Edge consulting price topology plugin download. Edge ranking new edge consulting buy percolation simulator.",
    "menu": "Home > Shop > Graphs > Hub Finder\nHome > Books > Posters > Tie Meter",
    "links": "[Best hub](http://a-b.example.org/x)\n[Top map print](www.c.test/y)\n* Pro finder: https://d.invalid/z1",
    "urls": "http://a.example/x | www.b.test/y | c-d.invalid/z | https://e.example.net/",
    "html": '<a href="http://a.example/x">2025 graph tool</a>\n<a href="b.test">Cheap hub app</a>',
    "tags": "#hubfinder #graph_tool #node #edge",
    "brackets": "[node tool] [hub app] [edge map] [graph kit]",
    "labels": "Graph Kit XL 1 | SKU KT-3675 | sale | gift | licence\nHub Kit S 3 | SKU KX-3727 | last items | free shipping | blue",
    "chinese": "边表转换 图论课程 边表转换 枢纽下载 图论课程 枢纽下载 边表转换",
}
SOUND = {
    "sentences": SENTENCES,
    "table": "graph | auc | time\ncedar | 1.5 | 300\ndunes | 2.5 | 200\nferry lines | 3 | 4.5",
    "csv": "warren,168.33,255.7,59\nopal mail,262,11.3,14",
    "log": "2024-02-27T14:58:32 INFO candidate=10 family=a valid=false score=65.6",
    "code": "import heapq\n\ndef order(G):\n    out = []\n    for x in G:\n        out.append(x)\n        continue\n    return out",
    "settings": "min_grain_limit = 0.162\nuse_gate_seed: null\ncap_rate: true",
    "citation": "[1] E. Stone, K. Field. We do not know why it jumps. Notes on Networks 57, 88-638 (2008).",
    "glossary": "arc: The family won twice, though by less than 33.\nrim: See the entry on arc for the definition of loss.",
    "chinese": "早期步骤决定了大部分指标，后期几乎不变。我们只在海报中展示结果。",
    "german": "Ab Schritt 826 steigt der Wert ohne erkennbaren Grund. Die ersten Schritte entscheiden fast alles.",
    "polish": "Wczoraj wieczorem porównaliśmy obie metody i zauważyliśmy niewielką różnicę. Budżet ustalono przed rozpoczęciem wyszukiwania, dlatego wynik jest wiarygodny.",
    "swedish": "Vi jämförde båda ordningarna igår kväll och såg en liten skillnad. Budgeten bestämdes innan sökningen började, så resultatet är pålitligt.",
    "italian": "Abbiamo confrontato entrambi gli ordini e abbiamo visto una piccola differenza. Nessuno si aspettava che una regola semplice vincesse su un grafo così grande.",
    "finnish": "Vertasimme molempia järjestyksiä eilen illalla ja havaitsimme pienen eron. Kukaan ei odottanut yksinkertaisen säännön voittavan näin suurella verkolla.",
    "turkish": "Dün akşam iki sıralamayı karşılaştırdık ve küçük bir fark gördük. Bütçe arama başlamadan önce belirlendi, bu yüzden sonuç güvenilir.",
    "russian": "Вчера вечером мы сравнили оба порядка и увидели небольшую разницу. Никто не ожидал, что простое правило победит на таком большом графе.",
    "recipe": "2 eggs\n200 g flour\na pinch of salt\n300 ml milk\nbutter for the pan\nsugar and lemon to serve",
    "one pattern": "The run on dunes took 31 seconds with a budget of five percent. The run on opal mail took 44 seconds with a budget of nine percent. " * 9,
    "two words": "naïve cœur ß ﬁ",
    "no words": "x" * 700 + "\n" + "-" * 300,
    "list of links among sentences": SENTENCES * 4 + "\nSee also\n- https://a.example/\n- www.b.test/x",
}


@pytest.mark.parametrize("name", SPAM)
def test_list_pages_are_told(name):
    assert list_share(SPAM[name]) > 0.9, name
    assert list_share(SPAM[name] + "\n\n" + SENTENCES * (2 + len(SPAM[name]) * 2 // len(SENTENCES))) < 0.5


@pytest.mark.parametrize("name", SOUND)
def test_sound_pages_are_left(name):
    assert list_share(SOUND[name]) < 0.3, name


def test_whole_texts_count():
    assert list_share(SENTENCES * 1000 + ("\n" + SPAM["keywords"]) * 3000) > 0.5
    assert list_share(SENTENCES * 3000 + ("\n" + SPAM["keywords"]) * 1000) < 0.5


def test_frame(spark):
    rows = [(1, SPAM["menu"], "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, SENTENCES, "x"), (1, SPAM["menu"], "x"), (None, SPAM["tags"], "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, list_share string")
    assert sorted(r.doc_id or 0 for r in list_pages(df).collect()) == [0, 1, 1]
    assert list_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["a.", "a-", "1.", "a ", " ", "\t", "[.]", "#a ", "[a] ", "a > ", "<a", "http://", "., ", "a1", "x=", "www.", "a[.]", "。", "- "])
def test_long_lines_take_linear_time(line):
    import time

    began = time.perf_counter()
    for text in (line * 200_000, "x" + line * 200_000 + "!", ("x" + line + " " * 50_000) * 3):
        list_share(text)
    assert time.perf_counter() - began < 20


def test_lists_of_many_shapes_count_whole():
    from shatterlens.llm import pages

    rows = [mark.join([f" {word} "] * n) for n in (3, 5, 9, 17) for mark in "|/>" for word in ("Home", "home")] + ["http://a.org/ " * n for n in (1, 2, 4)]
    page = "\n".join(rows)
    assert len({pages.line_shape(x, pages.line_kind(x)) for x in rows if pages.line_kind(x) == pages.LIST}) > 12
    assert pages.list_share(page) == 1 > pages.list_share(page, 12)


def test_giving_up_early_changes_no_verdict():
    texts = [*SPAM.values(), *SOUND.values()]
    for a in texts:
        for b in texts:
            for page in (f"{a}\n{b}", f"{a}\n{b}\n{b}", f"{a} {a}\n\n{b}"):
                share = list_share(page)
                early = list_share(page, least=0.5)
                assert early == share if share > 0.5 else early <= 0.5
