"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Base of all engine errors."""


class NotFound(EngineError):
    pass


class ProjectNotFound(NotFound):
    pass


class BranchNotFound(NotFound):
    pass


class InvalidPath(EngineError):
    pass


class InvalidObject(EngineError):
    """An object that doesn't decode or validate; also a wrong kind or schema version."""


class EntryTypeConflict(EngineError):
    """A note stands where a directory is needed, or the reverse."""


class DirectoryNotEmpty(EngineError):
    pass


class AmbiguousRef(EngineError):
    pass


class AmbiguousSlug(EngineError):
    def __init__(self, slug: str, candidates: list[str]):
        super().__init__(f"{slug!r} names several notes: {', '.join(candidates)}")
        self.candidates = candidates


class NotAncestor(EngineError):
    pass


class Diverged(EngineError):
    """Both sides have snapshots of their own; their histories meet."""


class NoCommonHistory(EngineError):
    pass


class MultipleBases(EngineError):
    def __init__(self, candidates: list[str]):
        super().__init__(f"several merge bases: {', '.join(candidates)}")
        self.candidates = candidates


class MergeConflicts(EngineError):
    def __init__(self, conflicts: list[dict], auto_merged: int):
        super().__init__(f"{len(conflicts)} conflicts, {auto_merged} entries merged")
        self.conflicts, self.auto_merged = conflicts, auto_merged


class Merging(EngineError):
    """A write that the unfinished merge forbids."""


class NoMergeState(EngineError):
    pass


class NothingStaged(EngineError):
    pass


class HeadMoved(EngineError):
    """The branch isn't where the writer expected it."""


class NoIndex(EngineError):
    pass


class IndexPruned(NoIndex):
    pass


class NoVectors(EngineError):
    pass


class ModelMismatch(EngineError):
    pass


class EmbedFailed(EngineError):
    pass


class LibraryNotEmpty(EngineError):
    pass


class VersionMismatch(EngineError):
    pass


class BadBatch(EngineError):
    """A batch rejected as a whole, with every problem found."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems
