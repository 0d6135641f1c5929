"""The registered whole-method queries run until no edge is active."""

import pytest

from karstflow.plans import queries


class _Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["full_run", "full_run_plan", "full_run_gamma", "full_run_single", "iteration_log"])
def test_no_bound_on_steps(monkeypatch, name):
    def detect(pairs, parameters):
        assert parameters.max_iter is None
        raise _Stop

    monkeypatch.setattr(queries, "detect", detect)
    monkeypatch.setattr(queries, "pairs", lambda spark, sf_dir: None)
    with pytest.raises(_Stop):
        getattr(queries, name)(None, None)
