"""What several test modules share."""

# The hand-made payload: a duplicate, a late row and two bad lines.
LINES = [
    "a|d|1472209316326|c1|1|1.5",
    "a|d|1472209316326|c1|1|1.5",
    "b|d|1472209317000|c1|2|2.5",
    "c|d|1472209321000|c1|4|1",
    "d|d|1472209331000|c1|8|1",
    "z|d|1472209100000|c1|100|9",
    "bad|line",
    "e|d|1472209330500|c2|x|1",
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))
