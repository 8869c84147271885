"""The entry module with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(block: str) -> set:
    code = f"import sys; sys.modules.update(dict.fromkeys({block!r}.split())); import __spark_entry__ as e; print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())


def test_other_queries_stay_without_the_subpackage():
    base = names("corpus_pipeline conflictlake.llm")
    assert "conflict_resolve" in base and not any(n.startswith("op") or n == "pipeline" for n in base)
    assert base <= names("")


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    import pytest

    from conflictlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)
