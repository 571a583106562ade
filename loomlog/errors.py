"""Errors, all of one base class, with the code and HTTP status that a route answers."""

from __future__ import annotations


class OplogError(Exception):
    code, status = "sync-protocol-error", 400


class InvalidSequenceError(OplogError):
    """A sequence that is no safe integer of its range."""


class InvalidLimitError(OplogError):
    """A limit that is no positive safe integer."""


class ProtocolLimitExceededError(OplogError):
    """More items than a limit allows."""


class DuplicateOperationIdError(OplogError):
    """An operation id that is taken."""


class InvalidProposalOrderError(OplogError):
    """Client sequences that don't rise within a batch."""


class UnknownBaseSequenceError(OplogError):
    """A base beyond the head of the log."""

    code, status = "future-base-sequence", 409


class OperationIdentityConflictError(OplogError):
    """An operation id that another client position holds."""

    code, status = "operation-identity-conflict", 409


class OperationIntentConflictError(OplogError):
    """An operation id that was decided with another intent."""

    code, status = "operation-intent-conflict", 409


class ClientSequenceConflictError(OplogError):
    """A client position that another operation holds."""

    code, status = "client-sequence-conflict", 409


class CommitConflictError(OplogError):
    """Another commit came first; the caller reads and decides again."""

    code, status = "sync-conflict", 409


class MalformedRequestError(OplogError):
    """A request that breaks the protocol."""


class MalformedResponseError(OplogError):
    """A response that breaks the protocol."""


class LogGapError(OplogError):
    """Entries are missing between a replica's log and a response."""


class LogDivergenceError(OplogError):
    """A response holds another entry than a replica at a sequence."""


class DecisionConflictError(OplogError):
    """Two decisions on one operation that disagree."""


class UnsupportedVersionError(OplogError):
    """An envelope of another protocol version."""


class WireDecodeError(OplogError):
    """An envelope that can't be read."""


class InvalidJsonValueError(OplogError):
    """A value that canonical JSON has no form for."""


class SchemaMismatchError(OplogError):
    """A stream bound to another schema."""


class SchemaDiscoveryError(OplogError):
    """A catalogue from which no contract can be made."""


class RowOperationError(OplogError):
    """A row operation that its contract doesn't allow."""


class ReplicaRecordError(OplogError):
    """A durable replica record that breaks an invariant."""


class BootstrapError(OplogError):
    """A first log where there is a log already."""


class RequestTooLargeError(OplogError):
    code, status = "request-too-large", 413


class BadRequestError(OplogError):
    code, status = "bad-request", 400


def answer(error: BaseException) -> tuple[int, str]:
    """HTTP status and code; what is none of ours is an internal error."""
    return (error.status, error.code) if isinstance(error, OplogError) else (500, "internal-error")
