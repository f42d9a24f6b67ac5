"""Outcomes of namespace and table calls, with the errno each stands for."""

from __future__ import annotations

import errno


class CairnError(Exception):
    """Any failure; errno EIO unless a subclass says better."""

    code = errno.EIO

    @property
    def errno_name(self) -> str:
        return errno.errorcode[self.code]


def _kind(name: str, code: int) -> type[CairnError]:
    return type(name, (CairnError,), {"code": code, "__doc__": f"errno {errno.errorcode[code]}", "__module__": __name__})


NotFound = _kind("NotFound", errno.ENOENT)
AlreadyExists = _kind("AlreadyExists", errno.EEXIST)
FileExpected = _kind("FileExpected", errno.EISDIR)
DirExpected = _kind("DirExpected", errno.ENOTDIR)
BadHandle = _kind("BadHandle", errno.EBADF)
TooManyOpens = _kind("TooManyOpens", errno.EMFILE)
AccessDenied = _kind("AccessDenied", errno.EACCES)
AssertionFailed = _kind("AssertionFailed", errno.EPERM)
ReadOnly = _kind("ReadOnly", errno.EROFS)
NotSupported = _kind("NotSupported", errno.ENOSYS)
InvalidArgument = _kind("InvalidArgument", errno.EINVAL)
Disconnected = _kind("Disconnected", errno.EPIPE)
BufferFull = _kind("BufferFull", errno.ENOBUFS)
OutOfRange = _kind("OutOfRange", errno.ERANGE)
