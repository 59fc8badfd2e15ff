import pytest

from symquarry.extract.table import EXTRACTORS, extract, extract_symbols, slices

CASES = {
    "ruby": ("LIMIT = 3\nmodule Shop\n  class Cart::Item < Base\n    attr_reader :price, :sku\n    def total(x) = x * 2\n    def self.open\n      if true then 1 end\n    end\n    class << self\n      def cheap?\n        [1].each do |x|\n          x\n        end\n      end\n    end\n    TEXT = <<~EOS\n      class Nope\n    EOS\n  end\nend\n",
             [(1, "const", "LIMIT", None), (2, "module", "Shop", None), (3, "class", "Cart::Item", "Shop"), (4, "method", "price", "Shop::Cart::Item"), (4, "method", "sku", "Shop::Cart::Item"), (5, "method", "total", "Shop::Cart::Item"), (6, "smethod", "open", "Shop::Cart::Item"), (10, "smethod", "cheap?", "Shop::Cart::Item"), (16, "const", "TEXT", "Shop::Cart::Item")]),
    "bash": ("A=1\nexport B='x{'\nfunction go {\n  C=2\n}\nrun() { D=${A}; }\nE=$(run)\n# F=1\n", [(1, "env", "A", None), (2, "env", "B", None), (3, "func", "go", None), (6, "func", "run", None), (7, "env", "E", None)]),
    "rust": ("impl<T: Copy> Tree<T> {\n    fn grow(&self) { fn inner() {} }\n}\ntrait Leaf { fn a(); fn b() {} }\nmod m { pub static S: &str = \"fn x() {\"; }\nimpl Leaf for Tree<u8> { const K: u8 = 1; }\n",
             [(2, "method", "grow", "Tree"), (2, "func", "inner", "Tree"), (4, "class", "Leaf", None), (4, "func", "b", None), (5, "module", "m", None), (5, "const", "S", "m"), (6, "const", "K", "Tree")]),
    "erlang": ("-module(m).\n-record(r, {a}).\n-define(X(A), A).\n-type t() :: a.\nf(a) -> \"x. y(\";\nf(b) -> c.\nf(a, B) -> {B}.\n", [(1, "module", "m", None), (2, "class", "r", None), (3, "const", "X", None), (4, "class", "t", None), (5, "func", "f", None), (7, "func", "f", None)]),
    "c": ("#define N 1\nstruct s { int a; };\nstruct s;\ntypedef int (*cb)(int);\ntypedef struct { int q; } one, two;\nstatic int f(struct s *x)\n{ if (x) { return 1; } return g(\"}\"); }\nint g(int);\nint v = 3;\n", [(1, "const", "N", None), (2, "class", "s", None), (4, "class", "cb", None), (5, "class", "one", None), (5, "class", "two", None), (6, "func", "f", None)]),
    "make": ("A := 1\nB += x \\\n  y\n.PHONY: all\nall test: dep\n\tC = 1\n%.o: %.c\nexport D ?= 2\n", [(1, "env", "A", None), (2, "env", "B", None), (5, "target", "all", None), (5, "target", "test", None), (8, "env", "D", None)]),
    "yaml": ("base: &b {x: 1, \"q\\tr\": 2}\nuse:\n  <<: *b\n  x: 9\nlist:\n  - k: *b\n", [(1, "key", "base", None), (1, "key", "base.x", None), (1, "key", "base.q\\tr", None), (2, "key", "use", None), (4, "key", "use.x", None), (1, "key", "use.q\\tr", None), (5, "key", "list", None), (6, "key", "list.k", None), (1, "key", "list.k.x", None), (1, "key", "list.k.q\\tr", None)]),
    "markdown": ("# One #\ntext\n---\n~~~\n# no\n~~~\n#\n## Two\n- a\n---\n", [(1, "heading", "One", None), (2, "heading", "text", None), (8, "heading", "Two", None)]),
    "dockerfile": ("ARG V=1\nFROM --platform=x base:${V} AS b\nENV A=\"x y=1\" \\\n    B=2\nENV OLD some value\nRUN ENV=3\n", [(1, "arg", "V", None), (2, "image", "base:${V}", None), (3, "env", "A", None), (4, "env", "B", None), (5, "env", "OLD", None)]),
    "javascript": ("class A extends B {\n  #x = () => 1\n  async go(a = {}) { const z = 1 }\n}\nconst N = 1, f = async x => { function hidden() {} }\nlet m = 3\nfunction g() { const q = 2; function h() {} }\nconst e = N + 1\nconst R = /a\\/b{/g\n", [(1, "class", "A", None), (3, "method", "go", "A"), (5, "const", "N", None), (5, "func", "f", None), (7, "func", "g", None), (7, "func", "h", None), (9, "const", "R", None)]),
    "typescript": ("export interface I { a(): void }\ntype T = { x: number }\ndeclare namespace A.B { const C: number; function f(x: T): void; class K { m(): void; } }\nexport const go = <X,>(x: X): X => x\n", [(1, "class", "I", None), (2, "class", "T", None), (3, "module", "A.B", None), (3, "func", "f", "A.B"), (3, "class", "K", "A.B"), (3, "method", "m", "A.B.K"), (4, "func", "go", None)]),
    "python": ("if True:\n    MAX = 1\nlow = 2\nNONE: int\nclass C:\n    A = 1\n    @dec\n    async def m(self):\n        def n(): pass\n", [(2, "const", "MAX", None), (5, "class", "C", None), (8, "method", "m", "C"), (9, "func", "n", "C.m")]),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_exact_lists(lang):
    source, expected = CASES[lang]
    assert [tuple(s) for s in extract(lang, source.encode())] == expected


@pytest.mark.parametrize("lang", sorted(EXTRACTORS))
def test_any_input_ends(lang):
    for source in (b"", b"\xff\xfe{{{", b"class (((\n" * 50, b"}" * 100 + b"'\"`", b"a: [1, {b: \n" * 5, b"<<EOS\nx"):
        extract(lang, source)


def test_python_that_does_not_parse():
    assert [tuple(s) for s in extract("python", b"class A:\n    def m(self):\n        x = (\nLIMIT = 3\n")] == [(1, "class", "A", None), (2, "method", "m", "A"), (4, "const", "LIMIT", None)]


def test_yaml_without_resolution_and_cycles():
    source = b"a: &x\n  <<: *x\n  k: 1\nb: *x\n"
    assert [s.name for s in extract("yaml", source)] == ["a", "a.k", "b", "b.k"]
    assert [s.name for s in extract("yaml", source, resolve_yaml=False)] == ["a", "a.k", "b"]


def test_yaml_names_and_merges():
    names = lambda text: [(s.line, s.name) for s in extract("yaml", text.encode())]
    assert names("'it''s': 1\n\"a\\\"b\": 2\n? [x]\n: 3\n") == [(1, "it''s"), (2, 'a\\"b'), (3, "")]
    # The first source wins, sources of a source come right behind it, any alias inside a merge is a source.
    text = "a: &a {x: 1, y: 1}\nb: &b\n  <<: *a\n  z: 1\nc:\n  <<: [*b, {k: *a}]\n  y: 2\n"
    assert names(text)[4:] == [(4, "b.z"), (1, "b.x"), (1, "b.y"), (5, "c"), (7, "c.y"), (4, "c.z"), (1, "c.x")]
    deep = "".join("  " * i + f"k{i}:\n" for i in range(12))
    assert [n.count(".") for _, n in names(deep)] == list(range(10))
    assert names("a: 1\nb: [\n") == [(1, "a"), (2, "b")]


def test_slices_hold_every_file():
    import pyarrow as pa

    data = [b"a" * n for n in (10, 0, 9 << 20, 5, 5 << 20, 5 << 20)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(data, pa.binary())], names=["i", "content"])
    assert [b.column(0).to_pylist() for b in slices([batch, batch.slice(0, 0)], 1)] == [[0, 1], [2], [3, 4], [5, 6]]


def test_table_function(spark):
    rows = [(1, "ruby", b"class A\nend\n"), (2, None, b"class A"), (3, "python", None), (4, "make", b"all:\n")]
    out = extract_symbols(spark.createDataFrame(rows, "id long, lang string, content binary")).orderBy("id").collect()
    assert [(r.id, r.lang, r.ordinal, r.line, r.kind, r.name) for r in out] == [(1, "ruby", 0, 1, "class", "A"), (4, "make", 0, 1, "target", "all")]
