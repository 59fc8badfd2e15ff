"""A small source file in each language, and the symbols it holds: (line, kind, name, scope).

``{k}`` stands for a number that tells files apart. The rows are written out by hand from the rules of
each language; extraction queries compare with them in SQL.
"""

from __future__ import annotations

SAMPLES: dict[str, tuple[str, list[tuple[int, str, str, str | None]]]] = {
    "ruby": (
        "LIMIT{k} = 3\nmodule Shop{k}\n  class Cart::Item < Base\n    attr_reader :price{k}, :sku\n    def total{k}(x) = x * 2\n    def self.open\n      if true then 1 end\n    end\n"
        "    class << self\n      def cheap?\n        [1].each do |x|\n          x\n        end\n      end\n    end\n    TEXT = <<~EOS\n      class Nope\n    EOS\n  end\nend\n",
        [
            (1, "const", "LIMIT{k}", None), (2, "module", "Shop{k}", None), (3, "class", "Cart::Item", "Shop{k}"), (4, "method", "price{k}", "Shop{k}::Cart::Item"),
            (4, "method", "sku", "Shop{k}::Cart::Item"), (5, "method", "total{k}", "Shop{k}::Cart::Item"), (6, "smethod", "open", "Shop{k}::Cart::Item"),
            (10, "smethod", "cheap?", "Shop{k}::Cart::Item"), (16, "const", "TEXT", "Shop{k}::Cart::Item"),
        ],
    ),
    "bash": (
        "A{k}=1\nexport B='x{'\nfunction go{k} {\n  C=2\n}\nrun() { D=${A}; }\nE=$(run)\n# F=1\ncat <<EOS\nG=1\nEOS\n",
        [(1, "env", "A{k}", None), (2, "env", "B", None), (3, "func", "go{k}", None), (6, "func", "run", None), (7, "env", "E", None)],
    ),
    "rust": (
        "impl<T: Copy> Tree{k}<T> {\n    fn grow(&self) { fn inner() {} }\n}\ntrait Leaf { fn a(); fn b() {} }\nmod m { pub static S: &str = \"fn x() {\"; }\n"
        "impl Leaf for Tree{k}<u8> { const K: u8 = 1; }\npub struct Point{k} { x: u8 }\nenum E { A }\nmacro_rules! twice { () => {} }\n",
        [
            (2, "method", "grow", "Tree{k}"), (2, "func", "inner", "Tree{k}"), (4, "class", "Leaf", None), (4, "func", "b", None), (5, "module", "m", None), (5, "const", "S", "m"),
            (6, "const", "K", "Tree{k}"), (7, "class", "Point{k}", None), (8, "class", "E", None), (9, "func", "twice", None),
        ],
    ),
    "erlang": (
        "-module(m{k}).\n-record(r, {a}).\n-define(X(A), A).\n-type t() :: a.\nf{k}(a) -> \"x. y(\";\nf{k}(b) -> c.\nf{k}(a, B) -> {B}.\n",
        [
            (1, "module", "m{k}", None), (2, "class", "r", None), (3, "const", "X", None), (4, "class", "t", None), (5, "func", "f{k}", None), (7, "func", "f{k}", None),
        ],
    ),
    "c": (
        "#define N{k} 1\nstruct s{k} { int a; };\nstruct s{k};\ntypedef int (*cb)(int);\ntypedef struct { int q; } one, two;\nstatic int f{k}(struct s *x)\n"
        "{ if (x) { return 1; } return g(\"}\"); }\nint g(int);\nint v = 3;\n#define SQ(x) ((x) * (x))\nenum e { A };\n",
        [
            (1, "const", "N{k}", None), (2, "class", "s{k}", None), (4, "class", "cb", None), (5, "class", "one", None), (5, "class", "two", None), (6, "func", "f{k}", None),
            (10, "const", "SQ", None), (11, "class", "e", None),
        ],
    ),
    "make": (
        "A{k} := 1\nB += x \\\n  y\n.PHONY: all\nall test{k}: dep\n\tC = 1\n%.o: %.c\nexport D ?= 2\n",
        [(1, "env", "A{k}", None), (2, "env", "B", None), (5, "target", "all", None), (5, "target", "test{k}", None), (8, "env", "D", None)],
    ),
    "yaml": (
        "base{k}: &b {x: 1, \"q\\tr\": 2}\nuse:\n  <<: *b\n  x: 9\nlist:\n  - k{k}: *b\n---\nsecond: *b\n",
        [
            (1, "key", "base{k}", None), (1, "key", "base{k}.x", None), (1, "key", "base{k}.q\\tr", None), (2, "key", "use", None), (4, "key", "use.x", None),
            (1, "key", "use.q\\tr", None), (5, "key", "list", None), (6, "key", "list.k{k}", None), (1, "key", "list.k{k}.x", None), (1, "key", "list.k{k}.q\\tr", None),
            (8, "key", "second", None),
        ],
    ),
    "markdown": (
        "# One {k} #\ntext {k}\n---\n~~~\n# no\n~~~\n#\n## Two\n- a\n---\n",
        [(1, "heading", "One {k}", None), (2, "heading", "text {k}", None), (8, "heading", "Two", None)],
    ),
    "dockerfile": (
        "ARG V{k}=1\nFROM --platform=x base{k}:${V} AS b\nENV A=\"x y=1\" \\\n    B=2\nENV OLD some value\nRUN ENV=3\n",
        [(1, "arg", "V{k}", None), (2, "image", "base{k}:${V}", None), (3, "env", "A", None), (4, "env", "B", None), (5, "env", "OLD", None)],
    ),
    "javascript": (
        "class A{k} extends B {\n  #x = () => 1\n  async go(a = {}) { const z = 1 }\n}\nconst N = 1, f = async x => { function hidden() {} }\nlet m = 3\n"
        "function g{k}() { const q = 2; function h() {} }\nconst e = N + 1\nconst R = /a\\/b{/g\n",
        [
            (1, "class", "A{k}", None), (3, "method", "go", "A{k}"), (5, "const", "N", None), (5, "func", "f", None), (7, "func", "g{k}", None), (7, "func", "h", None),
            (9, "const", "R", None),
        ],
    ),
    "typescript": (
        "export interface I{k} { a(): void }\ntype T = { x: number }\ndeclare namespace A.B { const C: number; function f(x: T): void; class K { m(): void; } }\n"
        "export const go{k} = <X,>(x: X): X => x\nexport enum Color { Red }\n",
        [
            (1, "class", "I{k}", None), (2, "class", "T", None), (3, "module", "A.B", None), (3, "func", "f", "A.B"), (3, "class", "K", "A.B"), (3, "method", "m", "A.B.K"),
            (4, "func", "go{k}", None), (5, "class", "Color", None),
        ],
    ),
    "tsx": (
        "export const View{k} = (p: Props) => <div>{p.name}</div>\nclass Box{k} extends Base {\n  render() { return <b>{this.x}</b> }\n}\n",
        [(1, "func", "View{k}", None), (2, "class", "Box{k}", None), (3, "method", "render", "Box{k}")],
    ),
    "python": (
        "if True:\n    MAX{k} = 1\nlow = 2\nNONE: int\nclass C{k}:\n    A = 1\n    @dec\n    async def m(self):\n        def n(): pass\n",
        [(2, "const", "MAX{k}", None), (5, "class", "C{k}", None), (8, "method", "m", "C{k}"), (9, "func", "n", "C{k}.m")],
    ),
}
