"""The bundle of relations writes what its parts share once."""

from quillmill import plans
from quillmill.operators import storage


def test_term_sets_are_written_once(spark, monkeypatch):
    names, new_path = [], storage.new_path

    def noted(session, name):
        names.append(name)
        return new_path(session, name)

    monkeypatch.setattr(storage, "new_path", noted)
    plans.queries()["relationship_bundle"](spark, "/root/testdata/sf0.001")
    assert names.count("term_sets") == 1
