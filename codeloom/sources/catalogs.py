"""Entry-point rules: YAML files on the driver, a small broadcast table in plans."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["rule", "kind", "threat_model", "language", "name_is", "name_starts", "name_ends", "symbol_kind", "file_is", "path_contains", "path_starts", "path_ends", "path_matches", "annotation", "argument_starts", "keyword", "directive", "main_guard", "is_exported", "top_level"]
FLAGS = ["main_guard", "is_exported", "top_level"]
SCHEMA = ", ".join(f"{c} {'boolean' if c in FLAGS else 'string'}" for c in COLUMNS)
#: The rules that come with the engine.
BUILT_IN = """
- {rule: bash-main, kind: main, threat_model: local, language: bash, name_is: main, symbol_kind: function}
- {rule: python-main-guard, kind: main, threat_model: local, language: python, main_guard: true}
- {rule: python-main-module, kind: main, threat_model: local, language: python, file_is: __main__.py, symbol_kind: function}
- {rule: go-main, kind: main, threat_model: local, language: go, name_is: main, symbol_kind: function}
- {rule: rust-main, kind: main, threat_model: local, language: rust, name_is: main, symbol_kind: function}
- {rule: zig-main, kind: main, threat_model: local, language: zig, name_is: main, symbol_kind: function}
- {rule: java-main, kind: main, threat_model: local, language: java, name_is: main, symbol_kind: method}
- {rule: pytest-function, kind: test, threat_model: none, language: python, name_starts: test_, path_matches: '(^|/)(test_[^/]*|[^/]*_test)[.]py$'}
- {rule: unittest-hook, kind: test, threat_model: none, language: python, name_is: setUp, symbol_kind: method}
- {rule: pytest-fixture, kind: test, threat_model: none, language: python, annotation: fixture}
- {rule: go-test, kind: test, threat_model: none, language: go, name_starts: Test, path_ends: _test.go}
- {rule: go-benchmark, kind: test, threat_model: none, language: go, name_starts: Benchmark, path_ends: _test.go}
- {rule: rust-test, kind: test, threat_model: none, language: rust, annotation: test}
- {rule: rust-integration-test, kind: test, threat_model: none, language: rust, path_starts: tests/, name_starts: test, top_level: true}
- {rule: zig-test, kind: test, threat_model: none, language: zig, keyword: test}
- {rule: junit-test, kind: test, threat_model: none, language: java, annotation: Test}
- {rule: junit-parameterized, kind: test, threat_model: none, language: java, annotation: ParameterizedTest}
- {rule: junit-before, kind: test, threat_model: none, language: java, annotation: BeforeEach}
- {rule: flask-route, kind: http, threat_model: remote, language: python, annotation: route, argument_starts: /}
- {rule: fastapi-get, kind: http, threat_model: remote, language: python, annotation: get}
- {rule: fastapi-post, kind: http, threat_model: remote, language: python, annotation: post}
- {rule: fastapi-put, kind: http, threat_model: remote, language: python, annotation: put}
- {rule: fastapi-patch, kind: http, threat_model: remote, language: python, annotation: patch}
- {rule: fastapi-delete, kind: http, threat_model: remote, language: python, annotation: delete}
- {rule: fastapi-websocket, kind: websocket, threat_model: remote, language: python, annotation: websocket}
- {rule: next-route, kind: http, threat_model: remote, language: typescript, path_matches: '(^|/)app/.*route[.]ts$', is_exported: true}
- {rule: next-page, kind: http, threat_model: remote, language: tsx, file_is: page.tsx, is_exported: true, top_level: true}
- {rule: next-server-action, kind: http, threat_model: remote, language: typescript, directive: use server, is_exported: true, symbol_kind: function}
- {rule: next-middleware, kind: http, threat_model: remote, language: typescript, file_is: middleware.ts, name_is: middleware}
- {rule: ts-test-file, kind: test, threat_model: none, language: typescript, path_ends: .test.ts, symbol_kind: function}
- {rule: nest-get, kind: http, threat_model: remote, language: typescript, annotation: Get}
- {rule: nest-post, kind: http, threat_model: remote, language: typescript, annotation: Post}
- {rule: celery-task, kind: task, threat_model: local, language: python, annotation: task}
- {rule: celery-shared-task, kind: task, threat_model: local, language: python, annotation: shared_task}
- {rule: lambda-handler, kind: serverless, threat_model: remote, language: python, name_is: lambda_handler, top_level: true}
- {rule: click-command, kind: main, threat_model: local, language: python, annotation: command}
- {rule: spring-get, kind: http, threat_model: remote, language: java, annotation: GetMapping}
- {rule: spring-post, kind: http, threat_model: remote, language: java, annotation: PostMapping}
- {rule: spring-put, kind: http, threat_model: remote, language: java, annotation: PutMapping}
- {rule: spring-delete, kind: http, threat_model: remote, language: java, annotation: DeleteMapping}
- {rule: spring-request, kind: http, threat_model: remote, language: java, annotation: RequestMapping}
- {rule: spring-scheduled, kind: schedule, threat_model: local, language: java, annotation: Scheduled}
- {rule: spring-kafka, kind: queue, threat_model: remote, language: java, annotation: KafkaListener}
- {rule: jaxrs-path, kind: http, threat_model: remote, language: java, annotation: Path}
- {rule: servlet-get, kind: http, threat_model: remote, language: java, name_is: doGet, symbol_kind: method}
- {rule: servlet-post, kind: http, threat_model: remote, language: java, name_is: doPost, symbol_kind: method}
- {rule: go-http-handler, kind: http, threat_model: remote, language: go, name_ends: Handler, symbol_kind: function, is_exported: true}
- {rule: actix-get, kind: http, threat_model: remote, language: rust, annotation: get, argument_starts: /}
- {rule: actix-post, kind: http, threat_model: remote, language: rust, annotation: post, argument_starts: /}
- {rule: tokio-main, kind: main, threat_model: local, language: rust, annotation: 'tokio::main'}
- {rule: terraform-variable, kind: infra-input, threat_model: local, language: hcl, path_ends: .tf, keyword: variable}
- {rule: migration-upgrade, kind: main, threat_model: local, language: python, path_contains: /migrations/, name_is: upgrade}
"""


def parse(text: str) -> list[tuple]:
    """Unknown fields and rules without a name or kind are refused."""
    import yaml

    out = []
    for rule in yaml.safe_load(text) or []:
        if odd := set(rule) - set(COLUMNS):
            raise ValueError(f"unknown fields {sorted(odd)} in {rule.get('rule')}")
        if not rule.get("rule") or not rule.get("kind"):
            raise ValueError(f"a rule needs a name and a kind: {rule}")
        out.append(tuple(rule.get(c) for c in COLUMNS))
    return out


def rules(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The built-in rules and those of a folder's .yaml files."""
    rows = parse(BUILT_IN)
    for path in sorted(Path(folder).glob("*.yaml")) if folder else []:
        rows += parse(path.read_text())
    return spark.createDataFrame(rows, SCHEMA)
