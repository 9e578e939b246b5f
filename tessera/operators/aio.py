"""Coroutines for every repository, unit-of-work and SQL call, cancellable through job tags."""

from __future__ import annotations

import asyncio
import uuid

from tessera.sources.guard import Call, running


class Async:
    """Wraps an object: each of its methods as a coroutine.

    The call runs in a worker thread under a job tag of its own; cancelling the coroutine cancels the
    jobs of that tag and leaves others alone.  What the call would have done after that (further jobs, a commit)
    doesn't happen.
    """

    def __init__(self, inner):
        self.inner = inner

    def __getattr__(self, name: str):
        target = getattr(self.inner, name)
        if not callable(target):
            return target
        sc = self.inner.spark.sparkContext

        async def call(*args, **kwargs):
            tag, own = f"async-{uuid.uuid4().hex}", Call()

            def work():
                sc.addJobTag(tag)
                try:
                    with running(own):
                        own.go_on()
                        return target(*args, **kwargs)
                finally:
                    sc.removeJobTag(tag)

            try:
                return await asyncio.to_thread(work)
            except asyncio.CancelledError:
                await asyncio.shield(asyncio.to_thread(own.stop))  # a commit that is under way ends first
                sc.cancelJobsWithTag(tag)
                raise

        call.__name__ = name
        return call

    async def execute_transaction(self, action):
        """``await action(self)`` in a transaction of its own: committed when it is done, rolled back if it raises or is cancelled."""
        await self.begin_transaction()
        try:
            result = await action(self)
        except BaseException:
            self.inner.rollback_transaction()  # starts no job
            raise
        try:
            await self.commit_transaction()
        finally:
            if self.inner.get_transaction() is not None:
                self.inner.rollback_transaction()
        return result


#: The coroutines of a repository, a unit of work and a SQL executor.
AsyncRepository = AsyncUnitOfWork = AsyncSqlExecutor = Async
