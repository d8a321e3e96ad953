"""A small workspace of many languages, for the report queries and tests."""

FILES = {
    "shop/__init__.py": "from .core import total as price\n",
    "shop/core.py": '''import os
from .util import clamp, unused_name


class Item:
    """One item."""

    def cost(self, n):
        return self.base() * n

    def base(self):
        return 1


class Book(Item):
    def base(self):
        return 7


def total(items, rate):
    raw = sum(i.cost(1) for i in items)
    taxed = raw * rate
    return clamp(taxed)


def settings():
    return os.getenv("SHOP_MODE"), os.environ["SHOP_TOKEN"]


def dead_a():
    return dead_b()


def dead_b():
    return dead_a()


def _spared():
    return 1
''',
    "shop/util.py": "LIMIT = 100\n\n\ndef clamp(value):\n    return min(value, LIMIT)\n\n\ndef orphan_helper(x):\n    return x\n",
    "app.py": '''from shop import price
import shop.core as c


def handler(order):
    lines = order
    result = price(lines, 2)
    return result


def main():
    book = c.Book()
    return handler([book])


if __name__ == "__main__":
    main()
''',
    "test_app.py": "from app import handler\n\n\ndef test_handler():\n    assert handler([]) == 0\n",
    "geo/shape.go": "package geo\n\ntype Shape interface {\n\tArea(k int) int\n}\n\ntype Square struct {\n\tSide int\n}\n\nfunc (s *Square) Area(k int) int {\n\tv := s.Side\n\treturn scale(v, k)\n}\n\nfunc scale(v int, k int) int {\n\treturn v * k\n}\n",
    "cmd/main.go": "package main\n\nimport (\n\t\"fmt\"\n\t\"example.org/m/geo\"\n)\n\nfunc main() {\n\tfmt.Println(geo.New())\n}\n",
    "web/cart.ts": "import { add as plus } from './sum';\n\nexport class Cart {\n  count: number;\n  put(n: number): number { return plus(n, this.count); }\n}\n\nexport function open() {\n  const mode = process.env.SHOP_MODE;\n  return new Cart();\n}\n",
    "web/sum.ts": "export function add(a: number, b: number): number {\n  return a + b;\n}\n",
    "web/page.html": '<div id="top" class="card big" data-kind="x"><a href="#top">up</a></div>\n',
    "web/a.css": "@layer base, theme;\n@layer base { .card { color: red; --ink: blue; } }\n.card { color: var(--ink); }\n.card.big { color: green; }\n.gone { color: black !important; }\n",
    "docs/guide.md": "# Big Guide\n\nCall `total` for prices, see [top](#big-guide) and [site][home].\n\n[home]: https://example.org\n",
    "infra/main.tf": 'variable "size" {\n  default = 1\n}\n\nvariable "zone" {\n  default = "a"\n}\n\nlocals {\n  twice = var.size\n}\n\noutput "size" {\n  value = local.twice\n}\n',
    "infra/terraform.tfvars": "size = 2\n",
    "infra/z.auto.tfvars": "size = 3\n",
    "chart/Chart.yaml": "name: shop\n",
    "chart/values.yaml": "image:\n  tag: one\nmode: fast\n",
    "chart/templates/app.yaml": "env:\n  - name: SHOP_MODE\n    value: {{ .Values.mode }}\n  - name: NOBODY\n    value: x\nimage: {{ .Values.image.tag }}\n",
    "run.sh": 'source ./lib.sh\nNAME=x\nstart() {\n  echo "$NAME"\n}\nstart\nhelp_me\n',
    "lib.sh": "help_me() {\n  echo hi\n}\n",
    "broken.py": "def oops(:\n    pass\n",
}
