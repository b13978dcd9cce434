"""What tests read out of a frame."""


def values(df, column, key="id"):
    return [r[column] for r in df.orderBy(key).collect()]
