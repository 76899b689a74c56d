"""Exceptions of the engine."""


class TooShort(ValueError):
    """The sample is too small for what is asked."""


class Misaligned(ValueError):
    """Series do not share an index, or frames do not pair up."""


class DidNotConverge(RuntimeError):
    """An iterative method stopped before it settled."""


class RiskParityDidNotConverge(DidNotConverge):
    def __init__(self, message: str, result) -> None:
        super().__init__(message)
        self.result = result


class GarchDidNotConverge(DidNotConverge):
    pass


class DidNotSolve(DidNotConverge):
    pass


class OutOfDomain(ValueError):
    pass


class NotSymmetric(ValueError):
    pass


class NotSquare(ValueError):
    pass


class NotPositiveDefinite(ValueError):
    pass


class RankDeficient(ValueError):
    pass


class NotAQuantileFunction(ValueError):
    pass


class NoRiskToAllocate(ValueError):
    pass


class NegativeContribution(ValueError):
    pass


class BadForecast(ValueError):
    pass


class BadScore(ValueError):
    pass


class NotEnoughTail(ValueError):
    pass


class OutsideTheFit(ValueError):
    pass


class ImpossibleFit(ValueError):
    pass


class UndefinedTailMean(ValueError):
    pass


class NotIdentified(ValueError):
    pass


class NoGaussianBaseline(ZeroDivisionError):
    pass


class BadBar(ValueError):
    pass


class BadLevel(ValueError):
    pass


class BadSpectrum(ValueError):
    pass


class ViewsInfeasible(ValueError):
    pass


class ViewsNotIdentified(ValueError):
    pass


class SaddlepointError(ValueError):
    pass


class NotIncreasing(ValueError):
    pass


class NoTailMean(ValueError):
    pass


class BadDimensions(ValueError):
    pass


class NotQuadratic(ValueError):
    pass


class OutsideSupport(ValueError):
    pass


class BadMixture(ValueError):
    pass


class InputError(ValueError):
    """A file that a reader refuses."""
