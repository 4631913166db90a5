from trilake.functions import terms, values  # noqa: F401
