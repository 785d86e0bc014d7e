"""Many questions at once against one after another."""

import pytest

from corpusloom.plans import batch
from corpusloom.plans.index import Index
from corpusloom.plans.providers import Models
from corpusloom.sources import repository

FILES = [
    ("app/main.py", "from app.util import load\n\ndef main():\n    return load()\n"), ("app/util.py", "def load():\n    return 1\n\nclass Store:\n    pass\n"),
    ("README.md", "# Tool\n\nHow loading works, in short.\n\n## Use\n\nCall main.\n"),
]


def by_kind():
    """A planner that is sent by value, as workers can't import a test."""

    class ByKind:
        """Steps that depend on the question and on how much was seen."""

        def step(self, question, context, seen):
            if "broken" in question and seen:
                raise RuntimeError("no answer")
            if "odd" in question:
                return ("no_such_tool", "x") if not seen else None
            plan = [("search_codebase", f"load {question[-1:]}"), ("get_file", "app/" if "many" in question else "app/util.py"), ("list_files", ""), ("get_file", "nowhere"), ("list_files", "")]
            return plan[len(seen)] if len(seen) < (2 if "short" in question else 5) else None

    return ByKind()


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame([(p, c, f"u/{p}", p.rpartition(".")[2]) for p, c in FILES], repository.FILES))


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_gathering_equals_one_question_at_a_time(spark, index):
    asked = [(1, "where is it, short 1", "c"), (2, "many files 2", ""), (3, "broken 3", "c"), (4, "odd 4", "c"), (5, "all of it 5", None), (6, None, "c")]
    models = Models(planner=by_kind())
    found = {r["question_id"]: [tuple(s) for s in r["steps"]] for r in batch.gather(index, spark.createDataFrame(asked, "question_id long, question string, context string"), models).collect()}
    assert {k: len(v) for k, v in found.items()} == {1: 2, 2: 4, 3: 1, 4: 0, 5: 4, 6: 4}
    for k, question, context in asked[:5]:
        assert found[k] == index.gather(question, context or "", models), question


def test_jobs_do_not_grow_with_questions(spark, index):
    table = lambda n: spark.createDataFrame([(k, f"what is it {k}", "c") for k in range(n)], "question_id long, question string, context string")
    run = lambda n: batch.gather(index, table(n), Models(planner=by_kind())).count()
    one = jobs(spark, "one", lambda: run(1))
    assert 0 < jobs(spark, "many", lambda: run(300)) <= 1.1 * one + 5


def test_answers_hold_context_steps_and_question(spark, index):
    asked = spark.createDataFrame([("a", "how does load work, short 1"), ("b", "odd")], "question_id string, question string")
    numbered = asked.selectExpr("CASE question_id WHEN 'a' THEN 1L ELSE 2L END AS question_id", "question")
    found = {r["question_id"]: r for r in batch.answers(index, numbered, Models(planner=by_kind())).collect()}
    one = "".join(e["text"] for e in index.answer("how does load work, short 1", Models(planner=by_kind())) if e["type"] == "token")
    assert found[1]["answer"] == one and len(found[1]["steps"]) == 2
    assert found[2]["steps"] == [] and "odd" in found[2]["answer"]


def test_no_questions_and_no_planner(spark, index):
    none = spark.createDataFrame([], "question_id long, question string, context string")
    assert batch.gather(index, none, Models(planner=by_kind())).count() == 0
    assert batch.gather(index, spark.createDataFrame([(1, "x", "c")], none.schema), Models()).first()["steps"] == []
