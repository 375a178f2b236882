"""Errors with the stable codes that callers rely on."""


class PlanError(ValueError):
    """A plan that cannot be carried out; code says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail
