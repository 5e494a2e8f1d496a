def same(a, b):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
