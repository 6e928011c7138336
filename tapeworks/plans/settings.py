"""Sizes of the registered queries, in bars: of a minute for most, of a second for those at full size."""

from types import SimpleNamespace

BAR, CONTEXT, HORIZON, STRIDE, MODES, ROLL, LOOKBACK = 60, 128, 60, 30, 8, 60, 120
#: Forecasters: name, and how far the last hour's (at full size: the last minute's) move leads the median.
MODELS = (("walk", 0.0), ("trend", 0.1), ("fade", -0.1))
POOL = (("near", 32, 1), ("mid", 64, 4), ("far", 128, 16))
#: Twelve hours of seconds behind a cursor, twenty-five minutes ahead; cursors overlap by a minute.
FULL = SimpleNamespace(BAR=1, CONTEXT=43_200, HORIZON=1_500, STRIDE=1_440, MODES=24, ROLL=60, LOOKBACK=900, MODELS=MODELS)
#: The same with cursors four hours apart.
APART = SimpleNamespace(**vars(FULL) | {"STRIDE": 14_400})
#: A day of minutes drawn by seed, with cursors ten minutes apart.
DRAWN = SimpleNamespace(BAR=60, CONTEXT=CONTEXT, HORIZON=HORIZON, STRIDE=10, MODES=MODES, ROLL=ROLL, LOOKBACK=LOOKBACK, MODELS=MODELS, DAY=1_440, SEED=7)
