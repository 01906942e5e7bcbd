"""Errors of the engine."""


class QuirefoldError(Exception):
    """Any error of this library."""


class SchemaError(QuirefoldError):
    pass


class CollectionNotFound(QuirefoldError):
    pass


class DocumentNotFound(QuirefoldError):
    pass


class ViewNotFound(QuirefoldError):
    pass


class ValidationFailed(QuirefoldError):
    pass


class ReadonlyCollection(QuirefoldError):
    pass


class PathConflict(QuirefoldError):
    pass


class ReferenceRestricted(QuirefoldError):
    pass


class PathTemplateError(QuirefoldError):
    pass


class FrontMatterError(QuirefoldError):
    pass


class MissplittableTemplate(QuirefoldError):
    pass


class MigrationFailed(QuirefoldError):
    pass


class QueryError(QuirefoldError):
    pass


class IndexLocked(QuirefoldError):
    pass
