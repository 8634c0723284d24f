"""Reference extraction on snippets of our own; weights (before x 0.3) worked from the rules."""

import time

import pytest

from helpers import items_df
from kinrank.operators import php as PHP
from kinrank.operators.overlap import ref_overlap
from kinrank.operators.refs import ref_edges
from kinrank.plans.features import item_features


def _bonus(spark, content, candidates, path="site/page.php"):
    src = items_df(spark, [path], {path: content}).selectExpr("100 AS item_id", "path", "content")
    got = {r.candidate: r.bonus for r in ref_overlap(ref_edges(src), item_features(items_df(spark, candidates))).collect()}
    return [got.get(i, 0.0) for i in range(len(candidates))]


SHOW, LIST, HOME = "theme/views/orders/show.blade.php", "theme/views/orders/list.blade.php", "theme/views/home.blade.php"
CASES = [
    ("<?php\necho view('orders.show');\n", [SHOW, LIST], [1.40, 1.40 * 2 / 3]),
    ("<x-price-tag />\n", ["theme/components/price-tag.blade.php", "theme/components/footer.blade.php"], [1.35, 0.0]),
    ("<?php\n$to = route('orders.show');\n", ["routes/web.php", "app/Mail.php"], [1.10, 0.0]),
    ("<?php\n$x = [OrderList::class];\n", ["app/order_list.php", "app/Order.php"], [1.25, 1.25 / 2]),
    ("<?php\nuse Shop\\Stock\\Shelf;\n", ["shop/stock/Shelf.php", "shop/Till.php"], [1.05, 0.0]),
    ("<?php\n$t = 'orders.show';\n$u = $t;\necho view($u);\n", [SHOW, HOME], [1.40, 0.0]),
    ("<?php\n$s = 'orders';\n$v = 'views.' . $s;\necho view($v . 'x');\n", [LIST, HOME], [1.40, 0.7]),
    ("<?php\n$t = (('orders.show'));\necho view($t, merge(one(two(3)), four()));\n", [SHOW, HOME], [1.40, 0.0]),
    ("<?php\n$t = lang('orders.show');\necho view($t);\n", [SHOW], [1.0]),       # as a quoted string only
    ("<?php\n$t = 'orders.show';\n$t = lang('x');\necho view($t);\n", [SHOW], [1.40]),
    ("<?php\necho view('orders.' . $x . 'y');\n", [SHOW], [0.0]),
    ("<?php\necho view(('orders.') . $kind);\n", [LIST], [1.40 * 0.8]),
    ("// view('orders.show')\n# view('orders.show')\n", [SHOW], [1.0]),
]


@pytest.mark.parametrize("content,candidates,want", CASES)
def test_php_bonuses(spark, content, candidates, want):
    assert _bonus(spark, content, candidates) == pytest.approx(want)


VALUES = [
    ("view('a', f(')'))", [("php_view", "a", True)]),
    ("view(\"it's\")", [("php_view", "it's", True)]),
    ("view('it\\'s')", [("php_view", "it\\'s", True)]),
    ("view('open)", []),
    ("view(('a.') . (('b')))", [("php_view", "a.b", True)]),
    ("view(f('a') . 'b')", [("php_view", "b", False)]),
    ("@includewhen($x, 'a.b')", [("php_view", "a.b", True)]),
    ("@includewhen('only')", []),
    ("$v = 'p.q';\nview($v)", [("php_view", "p.q", True)]),
    ("$v == 'p'\nview($v)", []),
    ("to_route('a')", [("php_route", "a", True)] * 2),
    ("VIEW('up.case')", [("php_view", "up.case", True)]),
]


@pytest.mark.parametrize("content,want", VALUES)
def test_argument_values(content, want):
    assert list(PHP.argument_values(content)) == want


@pytest.mark.parametrize("line", ["view($v, " + "x" * 1_000_000 + ")", "view(" + "(" * 100_000 + "'a.b'" + ")" * 100_000 + ")",
                                  "view('" + "a." * 500_000 + "')", "view(" + "'a' . " * 100_000 + "$b)", "view(" + "'" * 999_999])
def test_long_lines_end_soon(line):
    began = time.time()
    list(PHP.argument_values(line))
    assert time.time() - began < 20


def test_import_lines(spark):
    contents = {
        "a.py": "from tool.forge import X\nfrom . import anvil\nimport hammer as h, nail\n# import hidden\n",
        "b.rs": "use crate::smithy::IronBar;\nmod bellows;\nmod inline {\n",
        "C.java": "import static com.forge.Iron.Bar;\nimport java.util.*;\n",
        "d.cs": "using A = Forge.Iron.Bar;\nusing System;\n",
        "e.txt": "'never closed \"lib/iron/bars/list.ts\"\nsee \"lib/iron/list.ts\"\n",
    }
    items = items_df(spark, list(contents), contents)
    got = sorted((r.item_id, r.kind, tuple(r.tokens)) for r in ref_edges(items).collect())
    assert got == [
        (0, "python", ("anvil",)), (0, "python", ("hammer",)), (0, "python", ("tool", "forge")),
        (1, "rust", ("bellows",)), (1, "rust", ("smithy",)), (1, "rust", ("smithy", "iron", "bar")),
        (2, "java", ("forge", "iron", "bar")),
        (3, "csharp", ("forge", "iron", "bar")),
        (4, "quoted", ("iron", "list")),
    ]


def test_overlap_matches_brute_force(spark):
    import random
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(14)]
    refs = [(i % 9, [rng.choice(vocab) for _ in range(rng.randint(1, 5))], rng.choice([1.0, 1.4, 1.6])) for i in range(60)]
    paths = [(i, [rng.choice(vocab) for _ in range(rng.randint(0, 6))]) for i in range(40)]
    want = {}
    for t, toks, w in refs:
        for c, p in paths:
            share = sum(x in p for x in toks) / len(toks)
            if share >= 0.5 and c != t:
                want[t, c] = max(want.get((t, c), 0.0), min(share * w, 1.5))
    got = ref_overlap(spark.createDataFrame(refs, "item_id long, tokens array<string>, weight double"),
                      spark.createDataFrame(paths, "item_id long, path_tokens array<string>"))
    assert {(r.target, r.candidate): r.bonus for r in got.collect()} == pytest.approx(want)


def test_doubling_values_share_memory():
    from kinrank.operators import php
    def source(n, used):  # noqa: E306
        return "\n".join(["$a = 'x.y';", *["$a = 'z.' . $a . $a;"] * n, "return view($b);", f"return view({used});"])
    env = {"a": ("x.y", True)}
    plain = "x.y"
    for _ in range(12):
        plain = "z." + plain + plain
        env["a"] = php.resolve("'z.' . $a . $a", env)
    assert php.text_of(env["a"][0]) == plain and php.size_of(env["a"][0]) == len(plain)
    assert list(php.argument_values(source(12, "$a"))) == [("php_view", plain, True)]
    assert list(php.argument_values(source(40, "$a"))) == []                  # longer than LONGEST: refers to nothing
    assert list(php.argument_values(source(40, "'ui.home'"))) == [("php_view", "ui.home", True)]


def test_best_bonus_of_classes_expands_to_the_pairs(spark):
    """Each row of `overlap_classes` stands for the pairs of its members, self pairs left out, with their bonus."""
    import random
    from kinrank.operators import overlap as OV
    rng = random.Random(6)
    words = [f"t{i}" for i in range(6)]
    lists = [rng.choices(words, k=rng.randint(1, 4)) for _ in range(4)]
    refs = spark.createDataFrame([(i, rng.choice(lists), rng.choice([1.0, 1.9])) for i in range(25) for _ in range(2)],
                                 "item_id long, tokens array<string>, weight double")
    items = spark.createDataFrame([(i, rng.sample(words, rng.randint(1, 2))) for i in range(40)], "item_id long, path_tokens array<string>")
    uses, sets = OV.memberships(refs, items)
    t_class = {r.target: r.target_class for r in OV.target_classes(uses).collect()}
    c_class = {r.candidate: r.kind for r in sets.collect()}
    want = {}
    for r in OV.ref_overlap(refs, items).collect():
        want.setdefault((t_class[r.target], c_class[r.candidate]), []).append(r.bonus)
    got = {(r.target_class, r.candidate_class): (r.bonus, r.links) for r in OV.overlap_classes(refs, items).collect()}
    assert got == {k: (b[0], len(b)) for k, b in want.items()} and all(len(set(b)) == 1 for b in want.values())
