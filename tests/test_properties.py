"""Properties over random inputs."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.functions.signals import beta_cdf, beta_quantile, decode_wav, encode_wav
from lumenfold.operators import firewall, sampling


@given(st.integers(0, 10_000), st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.01, 100), min_size=1, max_size=6))
@settings(deadline=None)
def test_allocation_is_whole_and_near(total, ratios):
    got = sampling.allocate(total, ratios)
    share = sum(ratios.values())
    assert sum(got.values()) == total and got.keys() == ratios.keys()
    assert all(abs(got[k] - total * r / share) < 1 + 1e-6 for k, r in ratios.items())


@given(st.floats(0.001, 0.999), st.integers(1, 60), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_beta_quantile_inverts(p, a, b):
    assert math.isclose(beta_cdf(beta_quantile(p, a, b), a, b), p, abs_tol=1e-9)


@settings(deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=50))
def test_wav_round_trip(samples):
    rate, x = decode_wav(encode_wav(8000, samples))
    assert rate == 8000 and all(abs(a - b) < 1e-4 for a, b in zip(x, samples, strict=True))


_CONFIG = st.recursive(st.integers() | st.booleans(), lambda x: st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), _CONFIG, max_size=4))
@settings(deadline=None)
def test_a_configuration_equals_itself(config):
    assert firewall.changed_keys(config, config) == {}
    firewall.only_allowed_changes(config, config, set())
